"""Word documents from end to end: read, redact, write back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.config import DEFAULT, Config
from spanveil.operators.rewrite import rewrite_runs
from spanveil.plans.pipeline import Redaction, redact
from spanveil.sources import docx
from spanveil.sources.segments import run_offsets
from spanveil.sources.store import keep


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs with their offsets, segments) of the documents under ``path``."""
    runs = keep(run_offsets(docx.read_runs(spark, path)), "runs")
    return runs, docx.segments_of(runs)


def redact_documents(spark: SparkSession, path: str, output: str, config: Config = DEFAULT, clear_metadata: bool = True) -> Redaction:
    """Writes the redacted documents into the folder ``output``."""
    runs, segments = read_segments(spark, path)
    run = redact(segments, config)
    plan = run.replaced.select("doc_id", "key", "start", "end", "surrogate")
    contents = docx.write_documents(spark, path, rewrite_runs(runs, plan), clear_metadata)
    docx.save_documents(contents, output).write.format("noop").mode("overwrite").save()
    return run
