"""Scoring predicted spans against gold ones, sampling, and gold validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = "key"


def overlap(a: str = "g", b: str = "p") -> Column:
    return F.least(F.col(f"{a}_end"), F.col(f"{b}_end")) - F.greatest(F.col(f"{a}_start"), F.col(f"{b}_start"))


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(K, "pii_type", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))


def strict_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs with equal segment, type, start and end."""
    g, p = _named(gold, "g"), _named(pred, "p")
    return g.join(p.distinct(), [K, "pii_type"]).where("g_start = p_start and g_end = p_end")


def relaxed_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs of overlapping spans of one type: most overlap first, then
    gold and predicted order.  The fold runs inside each (segment, type)."""
    pairs = _named(gold, "g").join(_named(pred, "p"), [K, "pii_type"]).where(overlap() > 0)
    row = F.struct((-overlap()).alias("o"), "g_start", "g_end", "p_start", "p_end")
    kind = "array<struct<o:int,g_start:int,g_end:int,p_start:int,p_end:int>>"
    clash = lambda x: lambda y: ((y["g_start"] == x["g_start"]) & (y["g_end"] == x["g_end"])) | ((y["p_start"] == x["p_start"]) & (y["p_end"] == x["p_end"]))
    step = lambda a, x: F.when(F.exists(a, clash(x)), a).otherwise(F.concat(a, F.array(x)))
    taken = pairs.groupBy(K, "pii_type").agg(F.aggregate(F.array_sort(F.collect_set(row)).cast(kind), F.array().cast(kind), step).alias("m"))
    return taken.select(K, "pii_type", F.explode("m").alias("m")).select(K, "pii_type", "m.g_start", "m.g_end", "m.p_start", "m.p_end")


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _rate(tp, tp + fp), _rate(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _rate(2 * tp, 2 * tp + fp + fn).alias("f1")]


def counts(gold: DataFrame, pred: DataFrame, mode: str = "strict", by: tuple[str, ...] = ("pii_type",)) -> DataFrame:
    """``*by, tp, fp, fn`` from matched, predicted and gold counts."""
    found = (strict_match if mode == "strict" else relaxed_match)(gold, pred)
    parts = [(found, 1, 0, 0), (pred, 0, 1, 0), (gold, 0, 0, 1)]
    one = [df.groupBy(*by).agg(*[(F.count("*") * n).alias(c) for c, n in zip(("m", "p", "g"), ns)]) for df, *ns in parts]
    total = reduce(DataFrame.unionByName, one).groupBy(*by).agg(F.sum("m").alias("tp"), (F.sum("p") - F.sum("m")).alias("fp"), (F.sum("g") - F.sum("m")).alias("fn"))
    return total


def scores(gold: DataFrame, pred: DataFrame, mode: str = "strict") -> DataFrame:
    """Per-type rows, the pooled MICRO row, and the MACRO mean over types with support."""
    c = counts(gold, pred, mode)
    each = c.select("pii_type", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    pooled = c.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).select(F.lit("MICRO").alias("pii_type"), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    support = each.where("tp + fn > 0")
    macro = support.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], *[F.round(F.avg(x), 6).alias(x) for x in ("precision", "recall", "f1")]).select(F.lit("MACRO").alias("pii_type"), "tp", "fp", "fn", "precision", "recall", "f1")
    return each.unionByName(pooled).unionByName(macro)


def errors(gold: DataFrame, pred: DataFrame, mode: str = "strict") -> DataFrame:
    """``error, key, pii_type, start, end``: the gold spans that were missed (FN) and the
    predicted ones that match none (FP)."""
    found = (strict_match if mode == "strict" else relaxed_match)(gold, pred)
    if mode == "strict":
        found = found.withColumn("p_start", F.col("g_start")).withColumn("p_end", F.col("g_end"))
    out = []
    for error, spans, side in (("FN", gold, "g"), ("FP", pred, "p")):
        matched = found.select(K, "pii_type", F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"))
        left = spans.select(K, "pii_type", "start", "end").join(matched, [K, "pii_type", "start", "end"], "left_anti")
        out.append(left.select(F.lit(error).alias("error"), K, "pii_type", "start", "end"))
    return out[0].unionByName(out[1])


def missing_values(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Gold annotations ``key, pii_type, text`` whose text is not in their segment."""
    here = texts.select(K, F.col("text").alias("whole"))
    return gold.join(here, K).where(~F.col("whole").contains(F.col("text"))).select(K, "pii_type", "text")


def boundary_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Relaxed pairs whose bounds differ."""
    return relaxed_match(gold, pred).where("g_start <> p_start or g_end <> p_end")


def type_confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Missed gold spans that overlap a prediction of another type."""
    missed = _named(gold, "g").join(relaxed_match(gold, pred).select(K, "pii_type", "g_start", "g_end"), [K, "pii_type", "g_start", "g_end"], "left_anti")
    other = _named(pred, "p").withColumnRenamed("pii_type", "predicted")
    return missed.join(other, K).where((overlap() > 0) & (F.col("pii_type") != F.col("predicted"))).groupBy("pii_type", "predicted").agg(F.count("*").alias("n"))


def _merged(df: DataFrame) -> DataFrame:
    """Disjoint unions of the intervals of each segment."""
    w = Window.partitionBy(K).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w)
    return df.select(K, "start", "end").withColumn("reach", reach).withColumn("i", island).groupBy(K, "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def character_metrics(texts: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Binary character confusion by interval arithmetic; no character is ever a row."""
    g, p = _merged(gold), _merged(pred)
    size = lambda df, name: df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(name))
    both = g.select(K, F.col("start").alias("g_start"), F.col("end").alias("g_end")).join(p.select(K, F.col("start").alias("p_start"), F.col("end").alias("p_end")), K).where(overlap() > 0)
    row = size(g, "g").crossJoin(size(p, "p")).crossJoin(both.agg(F.coalesce(F.sum(overlap()), F.lit(0)).alias("tp"))).crossJoin(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")))  # one row each
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp")
    tn = F.col("n") - tp - fp - fn
    return row.select("tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), _rate(tp + tn, F.col("n")).alias("accuracy"))


def segment_metrics(texts: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Segments with and without any span, predicted and gold."""
    flag = lambda df, name: df.select(K).distinct().withColumn(name, F.lit(True))
    x = texts.select(K).join(flag(gold, "g"), K, "left").join(flag(pred, "p"), K, "left").select(F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("p", F.lit(False)).alias("p"))
    c = x.agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"), F.count_if(F.expr("not g and not p")).alias("tn"))
    return c.withColumn("accuracy", _rate(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def by_stratum(strata: DataFrame, gold: DataFrame, pred: DataFrame, mode: str = "relaxed") -> DataFrame:
    """Micro scores of each stratum."""
    s = strata.select(K, "stratum")
    found = (strict_match if mode == "strict" else relaxed_match)(gold, pred)
    parts = [df.join(s, K).groupBy("stratum").agg(*[(F.count("*") * n).alias(c) for c, n in zip("mpg", ns)]) for df, *ns in ((found, 1, 0, 0), (pred, 0, 1, 0), (gold, 0, 0, 1))]
    c = reduce(DataFrame.unionByName, parts).groupBy("stratum").agg(F.sum("m").alias("tp"), (F.sum("p") - F.sum("m")).alias("fp"), (F.sum("g") - F.sum("m")).alias("fn"))
    return c.select("stratum", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


CONTACT = r"(?i)@|\+\d{1,3}[ \-]?\d|\b\d{6}\b|\b(?:tel|phone|mobile|e-?mail|contact)\b"


def classify(segments: DataFrame) -> DataFrame:
    """Stratum of each segment: structural, contact, prose, negative, or null."""
    text = F.col("text")
    structural = F.coalesce(F.lower("column_header").rlike(r"\b(?:name|address|din|pan|director)\b"), F.lit(False))
    return segments.withColumn("stratum", F.when(structural, "structural").when(text.rlike(CONTACT), "contact").when((F.col("kind") != "table-cell") & (F.length(text) >= 120), "prose").when((F.col("kind") == "table-cell") & (F.length(text) >= 8), "negative"))


def stratified_sample(classified: DataFrame, sizes: dict[str, int], seed: int, pinned: tuple[str, ...] = ()) -> DataFrame:
    """Whole strata, or so many segments of a stratum by the hash of their key, and pinned keys."""
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(K))), K)
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in (sizes or {"": 0}).items() for x in kv])[F.col("stratum")], F.lit(1 << 30))
    ranked = classified.where("stratum is not null").withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= limit) | F.col(K).isin(list(pinned))).drop("rank")


def unknown_keys(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Gold annotations of segments that don't exist."""
    return gold.join(texts.select(K), K, "left_anti")


def overlapping_gold(gold: DataFrame) -> DataFrame:
    w = Window.partitionBy(K).orderBy("start", "end")
    return gold.withColumn("before", F.lag("end").over(w)).where("before > start").drop("before")


def nth_occurrence(text: Column, part: Column, n: int) -> Column:
    """0-based start of the n-th occurrence, overlapping ones counted; null if there are fewer."""
    at = F.locate
    found = F.expr("0")
    for _ in range(n):
        found = F.when(found.isNotNull(), F.nullif(F.call_function("locate", part, text, found + 1), F.lit(0)))
    return found - 1


def top_per_type(replaced: DataFrame, n: int = 14) -> DataFrame:
    """The longest originals of each type."""
    w = Window.partitionBy("pii_type").orderBy(F.length("text").desc(), "text")
    return replaced.select("pii_type", "text").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
