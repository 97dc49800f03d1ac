"""Overlap resolution: floor, duplicates, and a priority-greedy fold for each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.config import PRIORITY, SPAN, Config

KEY = ("doc_id", "key")
LEAST = 3
STRIP = " \t,;:|.-–—"


def priority(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), kind)


def confidence_floor(spans: DataFrame, floor: float) -> DataFrame:
    return spans.where(F.col("confidence") >= floor) if floor > 0 else spans


def merge_duplicates(spans: DataFrame) -> DataFrame:
    """One span for each (segment, start, end, type): the best confidence, and the names of
    all detectors that agree."""
    return spans.groupBy(*KEY, "start", "end", "pii_type").agg(
        F.max_by("text", F.struct("confidence", "detector")).alias("text"),
        F.array_join(F.array_sort(F.collect_set("detector")), "+").alias("detector"),
        F.max("confidence").alias("confidence"),
    )


def _claims(spans: DataFrame) -> DataFrame:
    """Claims of a segment in the order of the fold: priority, longest, first, surest, name."""
    order = F.struct(priority(F.col("pii_type")).alias("p"), (F.col("start") - F.col("end")).alias("l"), F.col("start").alias("s"), (-F.col("confidence")).alias("f"), F.col("detector").alias("d"), F.struct("start", "end", "text", "pii_type", "detector", "confidence").alias("c"))
    return spans.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["c"].cast(SPAN)).alias("claims"))


def _cut(c: Column, a: Column) -> Column:
    """Claim ``c`` beside an accepted ``a``: unchanged, the longer free side, or start -1."""
    def set_(start: Column, end: Column) -> Column:
        part = F.substring(c["text"], start - c["start"] + 1, end - start)
        left = F.length(part) - F.length(F.ltrim(part, F.lit(STRIP)))
        body = F.trim(part, F.lit(STRIP))
        fine = (end - start >= LEAST) & (F.length(body) >= LEAST)
        first = F.when(fine, start + left).otherwise(F.lit(-1))
        return F.struct(first.alias("start"), (first + F.length(body)).alias("end"), body.alias("text"), c["pii_type"].alias("pii_type"), c["detector"].alias("detector"), c["confidence"].alias("confidence")).cast(SPAN)

    apart = (c["start"] < 0) | (c["start"] >= a["end"]) | (a["start"] >= c["end"])
    inside = (c["start"] >= a["start"]) & (c["end"] <= a["end"])
    gone = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), c["text"].alias("text"), c["pii_type"].alias("pii_type"), c["detector"].alias("detector"), c["confidence"].alias("confidence")).cast(SPAN)
    left, right = a["start"] - c["start"], c["end"] - a["end"]
    return F.when(apart, c).when(inside, gone).when(left >= right, set_(c["start"], a["start"])).otherwise(set_(a["end"], c["end"]))


def resolve_claims(claims: Column) -> Column:
    """The fold in Catalyst: each claim meets all accepted ones and is kept, cut or dropped."""
    def step(accepted: Column, claim: Column) -> Column:
        left = F.aggregate(accepted, claim, _cut)
        return F.filter(F.concat(accepted, F.array(left)), lambda x: x["start"] >= 0)

    return F.array_sort(F.aggregate(claims, F.array().cast(f"array<{SPAN}>"), step))


def resolve(spans: DataFrame, config: Config) -> DataFrame:
    """Disjoint spans of every segment.  Segments are independent, so the only shuffle is
    the one by segment."""
    claims = _claims(merge_duplicates(confidence_floor(spans, config.min_confidence)))
    return claims.select(*KEY, F.explode(resolve_claims(F.col("claims"))).alias("s")).select(*KEY, "s.*")


def resolution_stats(spans: DataFrame, config: Config) -> DataFrame:
    """One row of counters over the corpus: spans that came in, fell below the floor, were
    merged, were contained in or cut away by others, were shortened, and went out."""
    kept = confidence_floor(spans, config.min_confidence)
    merged, final = merge_duplicates(kept), resolve(spans, config)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    cut = final.join(merged, [*KEY, "start", "end", "pii_type"], "left_anti")
    out = count(spans, "n_input").crossJoin(count(kept, "n_kept")).crossJoin(count(merged, "n_merged")).crossJoin(count(final, "n_output")).crossJoin(count(cut, "n_truncated"))  # one row each
    return out.select("n_input", (F.col("n_input") - F.col("n_kept")).alias("n_low_confidence"), (F.col("n_kept") - F.col("n_merged")).alias("n_duplicates"), (F.col("n_merged") - F.col("n_output")).alias("n_dropped"), "n_truncated", "n_output")


def overlapping(spans: DataFrame) -> DataFrame:
    """Resolved spans that overlap the one before them; empty if all is well."""
    w = Window.partitionBy(*KEY).orderBy("start", "end")
    return spans.withColumn("before", F.lag("end").over(w)).where(F.col("before") > F.col("start")).drop("before")
