"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import WORD, cut

CAP = 3.0
SEED = 42


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """``source, source_size`` -> ``source, source_size, target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes.  No target exceeds ``cap`` times its source's size; the
    excess goes to the others by weight until none is above.  That fixed point
    is water filling: with sources ordered by ``cap * size / weight``, a prefix of
    them is capped, and the rest get ``weight * level`` for one level.

    The table has one row for each source, so the windows over all of it are
    over the dimension table, not over documents.  No sources, or only empty
    ones: the targets are 0."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int"))
    t = (
        sizes.withColumn("weight", w)
        .withColumn("limit", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("weight").over(everything))
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left_total = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left_total / left_w)
    # the first source, in this order, whose cap is at or above the level ends the capped prefix
    t = t.withColumn("place", F.row_number().over(by_ratio))
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(everything)
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce(level, F.col("ratio")))
    return t.select("source", "source_size", target.alias("target"))


def unit_interval(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("␀")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(docs: DataFrame, seed: int) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``size, source_size, target, copies``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = rows.select("row", size_of(F.col("row.text")).alias("size"), unit_interval(seed, F.col("row.doc_id"), F.md5(F.coalesce("row.text", F.lit("")))).alias("draw"))
    totals = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    # written, so that its size is known and Spark broadcasts it only while it is small
    targets = cut(source_targets(totals), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = own.join(targets, F.col("row.source").eqNullSafe(F.col("source")), "left").withColumn("rate", rate)
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_plan(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each document: ``doc_id, source, size, source_size, target, copies,
    taken``.

    ``copies`` is the whole part of target / source_size and one more with the
    fraction as its probability, drawn from a hash of seed, doc_id and text, so
    reruns agree.  Null text or no word: size 0, taken 0.  Rows that agree in doc_id
    and text draw alike: a source of nothing but such rows is not near its target.
    An empty table gives no rows.  Sources are summed with map-side partial sums, so
    a hot one is no hot task."""
    return plan(docs, seed).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as :func:`mix_plan` says, with
    all their columns whatever these are called."""
    rows = plan(docs, seed).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("row.*")
