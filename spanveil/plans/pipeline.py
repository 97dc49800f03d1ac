"""The plans: detect (two passes, resolve), redact (surrogates, rewrite, reports), evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.config import DEFAULT, Config
from spanveil.operators import evaluate as E
from spanveil.operators import scanning  # noqa: F401  (registers its detectors)
from spanveil.operators.detectors import active
from spanveil.operators.gazetteer import build, sweep, sweep_ngrams
from spanveil.operators.resolve import resolution_stats, resolve
from spanveil.operators.rewrite import leaks, skipped, without_survivors, write_stats
from spanveil.operators.rewrite import redact as rewrite_text
from spanveil.operators.surrogates import replacements
from spanveil.sources.ner import ner_spans
from spanveil.sources.store import keep


def spread(segments: DataFrame) -> DataFrame:
    """A table of few large row groups would run on few cores; deal it out.  Large tables
    have more partitions than the cluster has cores and stay as they are."""
    cores = segments.sparkSession.sparkContext.defaultParallelism
    return segments.repartition(cores) if segments.rdd.getNumPartitions() <= cores else segments


def pass_one(segments: DataFrame, config: Config = DEFAULT, seeding: bool = False) -> DataFrame:
    """Raw spans of all active detectors from one scan.  ``seeding`` keeps kinds that
    only feed the dictionary."""
    found = [d.build(config) for d in active(config)]
    if not found:
        return segments.sparkSession.createDataFrame([], "doc_id string, key string, start int, end int, text string, pii_type string, detector string, confidence double")
    spans = spread(segments.where("text is not null").select("doc_id", "key", "text", "column_header")).select("doc_id", "key", F.explode(F.concat(*found)).alias("s")).select("doc_id", "key", "s.*")
    return spans if seeding else spans.where(F.col("pii_type").isin(list(config.types)))


@dataclass(frozen=True)
class Detection:
    """Lazily evaluated frames of one run."""

    raw: DataFrame
    gazetteer: DataFrame
    spans: DataFrame


def detect(segments: DataFrame, config: Config = DEFAULT, ner: DataFrame | None = None) -> Detection:
    """Pass 1, the dictionary, pass 2 and resolution.  The text is scanned once for pass 1
    and once, where its scope has entries, for pass 2.  ``ner``: entities of a model, if any."""
    spans = pass_one(segments, config, seeding=True)
    if ner is not None:
        spans = spans.unionByName(ner_spans(ner, segments))
    first = keep(spans, "pass-one")  # spans only: small beside the text
    gazetteer = keep(build(first, segments, config), "gazetteer") if config.sweep else build(first, segments, config)
    raw = first
    if config.sweep:
        # the dictionary of a document is one small pattern, that of a corpus is not
        again = sweep if config.scope == "doc_id" else sweep_ngrams
        raw = raw.unionByName(again(segments, gazetteer, config))
    raw = raw.where(F.col("pii_type").isin(list(config.types)))
    return Detection(raw, gazetteer, resolve(raw, config))


@dataclass(frozen=True)
class Redaction:
    detection: Detection
    replaced: DataFrame
    segments: DataFrame
    leaks: DataFrame
    config: Config = DEFAULT


def redact(segments: DataFrame, config: Config = DEFAULT) -> Redaction:
    found = detect(segments, config)
    replaced = without_survivors(segments, keep(replacements(found.spans, found.gazetteer, config), "replaced"))
    out = rewrite_text(segments, replaced)
    return Redaction(found, replaced, out, leaks(out, replaced), config)


def summary(run: Redaction) -> DataFrame:
    """Counts by type and detector, as one JSON column."""
    by = run.replaced.groupBy("pii_type", "detector").agg(F.count("*").alias("n"))
    return by.groupBy("pii_type").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "n")))).alias("by_detector")).select(F.to_json(F.struct("*")).alias("summary"))


def report(run: Redaction, timings: dict[str, float] | None = None, first: int = 20) -> DataFrame:
    """One row with one JSON text: counts by type, of the resolution and of the rewriting,
    replacements that were skipped, the first leaks and how many there are, and timings
    if they are given."""
    by = run.replaced.groupBy("pii_type").agg(F.count("*").alias("n"))  # a row for each type
    types = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "n")))).alias("by_type"))
    written = write_stats(run.replaced).select(F.struct("*").alias("rewriting"))
    left = run.leaks.agg(F.count("*").alias("n_leaks"))
    some = run.leaks.orderBy("doc_id", "key", "original").limit(first).agg(F.array_sort(F.collect_list(F.struct("doc_id", "key", "original"))).alias("first_leaks"))
    lost = skipped(run.segments, run.replaced).agg(F.count("*").alias("n_skipped"))
    found = resolution_stats(run.detection.raw, run.config).select(F.struct("*").alias("resolution"))
    row = types.crossJoin(found).crossJoin(written).crossJoin(lost).crossJoin(left).crossJoin(some)  # one row each
    took = F.lit(None).cast("map<string,double>") if not timings else F.create_map(*[F.lit(x) for kv in timings.items() for x in kv])
    return row.select(F.to_json(F.struct("*", took.alias("timings"))).alias("report"))


#: Settings that are compared in an ablation, and whether entities of a model take part.
ABLATIONS = {
    "full": (DEFAULT, True),
    "no_sweep": (Config(sweep=False), True),
    "no_ner": (DEFAULT, False),
    "no_ner_no_sweep": (Config(sweep=False), False),
    "no_person": (DEFAULT.without("person.hybrid"), False),
    "floor_0": (Config(min_confidence=0.0), True),
    "floor_90": (Config(min_confidence=0.90), True),
}


def ablations(segments: DataFrame, gold: DataFrame, ner: DataFrame | None = None, configs: dict[str, tuple[Config, bool]] = ABLATIONS, mode: str = "relaxed") -> DataFrame:
    """Scores of each setting; ``ner``: entities of a model, if any."""
    out = None
    for name, (config, model) in configs.items():
        rows = E.scores(gold, detect(segments, config, ner if model else None).spans, mode).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
