"""Command line: redact, scan and list detectors.  ``python -m spanveil.plans scan INPUT``"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanveil.config import DEFAULT, parse_types
from spanveil.operators.detectors import REGISTRY
from spanveil.operators.rewrite import audit_log, mapping
from spanveil.plans.documents import read_segments, redact_documents
from spanveil.plans.pipeline import detect, redact, summary
from spanveil.sources.segments import _segments


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanveil")
    p.add_argument("command", choices=("redact", "scan", "detectors"))
    p.add_argument("input", nargs="?", help="a parquet table with doc_id and text, or .docx files")
    p.add_argument("output", nargs="?", help="a table, or for documents a folder that all executors reach")
    p.add_argument("--docx", action="store_true", help="the input is a folder of .docx files (files of that name are known)")
    p.add_argument("--report-dir")
    p.add_argument("--types", default="all")
    p.add_argument("--seed", type=int, default=DEFAULT.seed)
    p.add_argument("--min-confidence", type=float, default=DEFAULT.min_confidence)
    p.add_argument("--no-sweep", action="store_true")
    p.add_argument("--dob-mode", default="labelled", choices=("labelled", "contextual"))
    p.add_argument("--disable", action="append", default=[])
    p.add_argument("--keep-metadata", action="store_true")
    p.add_argument("--show", type=int, default=0)
    p.add_argument("--json", action="store_true", help="scan: counts as JSON lines")
    p.add_argument("--quiet", action="store_true")
    return p


def main(argv: list[str]) -> int:
    a = parser().parse_intermixed_args(argv)
    if a.command == "detectors":
        for d in sorted(REGISTRY.values(), key=lambda d: d.name):
            print(d.name, ",".join(d.types))
        return 0
    config = replace(DEFAULT, types=parse_types(a.types), seed=a.seed, min_confidence=a.min_confidence, sweep=not a.no_sweep, dob_mode=a.dob_mode, disabled=tuple(a.disable))
    spark = SparkSession.builder.appName("spanveil").getOrCreate()
    word = a.docx or a.input.endswith(".docx")
    if word:
        segments = read_segments(spark, a.input)[1]
    else:
        segments = _segments(spark.read.parquet(a.input), F.col("doc_id"), F.lit(0), F.col("text"), "paragraph")
    if a.command == "scan":
        spans = detect(segments, config).spans
        counts = spans.groupBy("pii_type", "detector").count().orderBy("pii_type", "detector")  # a row for each detector
        if a.json:
            for row in counts.toJSON().collect():
                print(row)
        elif not a.quiet:
            counts.show(200, False)
        if a.show and not a.quiet:
            spans.orderBy("doc_id", "key", "start").show(a.show, False)
        return 0
    if word:
        run = redact_documents(spark, a.input, a.output, config, not a.keep_metadata)
    else:
        run = redact(segments, config)
        run.segments.write.mode("overwrite").parquet(a.output)
    if a.report_dir:
        log = audit_log(segments, run.replaced).orderBy("doc_id", "seq", "start")
        log.write.mode("overwrite").option("header", True).csv(f"{a.report_dir}/audit_log")
        mapping(run.replaced).orderBy("scope", "pii_type", "original").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{a.report_dir}/mapping")
        summary(run).write.mode("overwrite").text(f"{a.report_dir}/run_summary")
    left = run.leaks.limit(20).collect()  # a report of the first leaks
    for row in left if not a.quiet else ():
        print("leak:", row["key"], file=sys.stderr)
    return 1 if left else 0


def cli() -> int:
    return main(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(cli())
