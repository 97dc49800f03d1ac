"""Rewriting text from a plan of disjoint replacements, leak check and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.text import matches
from spanveil.operators.resolve import KEY
from spanveil.sources.store import keep


def splice(text: Column, plan: Column) -> Column:
    """``text`` with each (start, end, surrogate) of the sorted plan put in place."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, p: F.struct(p["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, p["start"] - a["at"]), p["surrogate"]).alias("out"))
    return F.aggregate(plan, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redact(segments: DataFrame, replaced: DataFrame) -> DataFrame:
    """Segments with ``redacted``; those without a span keep their text."""
    plans = replaced.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "surrogate"))).alias("plan"))
    empty = F.array().cast("array<struct<start:int,end:int,surrogate:string>>")
    return segments.join(plans, list(KEY), "left").withColumn("redacted", splice(F.col("text"), F.coalesce("plan", empty))).drop("plan")


def skipped(segments: DataFrame, replaced: DataFrame) -> DataFrame:
    """Replacements of segments that do not exist."""
    return replaced.join(segments.select(*KEY), list(KEY), "left_anti")


def leaks(redacted: DataFrame, replaced: DataFrame) -> DataFrame:
    """Originals of four characters or more that still stand in any segment of their document."""
    values = replaced.select("doc_id", F.trim("text").alias("original")).where(F.length("original") >= 4).distinct()
    return redacted.select("doc_id", "key", "redacted").join(values, "doc_id").where(F.col("redacted").contains(F.col("original"))).select("doc_id", "key", "original")


def without_survivors(segments: DataFrame, replaced: DataFrame) -> DataFrame:
    """``replaced`` and a replacement for every place where an original would still stand, as
    it does inside a longer word, which no sweep enters: the value's own surrogate takes
    it.  Between two replacements the longest value is met first, so none is left."""
    left = keep(leaks(redact(segments, replaced), replaced), "survivors")
    if left.isEmpty():
        return replaced
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("original"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    forms = F.array_sort(F.collect_set(F.struct((-F.length("original")).alias("n"), quoted.alias("p"))))
    asked = left.groupBy(*KEY).agg(F.array_join(F.transform(forms, lambda x: x["p"]), "|").alias("pattern"))
    taken = replaced.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("taken"))
    rows = segments.select(*KEY, "text").join(asked, list(KEY)).join(taken, list(KEY), "left")
    spans = F.coalesce("taken", F.array().cast("array<struct<start:int,end:int>>"))
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"])).alias("at"), F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length("text"))).alias("to"))
    pieces = rows.select(*KEY, "text", "pattern", F.explode(gaps).alias("g")).select(*KEY, "pattern", "g.at", F.substring("text", F.col("g.at") + 1, F.col("g.to") - F.col("g.at")).alias("piece"))
    hits = pieces.select(*KEY, "at", F.explode(matches(F.col("piece"), F.col("pattern"))).alias("m"))
    hits = hits.select(*KEY, (F.col("at") + F.col("m.start")).alias("start"), (F.col("at") + F.col("m.end")).alias("end"), F.col("m.text").alias("text"))
    same = [c for c in replaced.columns if c not in (*hits.columns, "detector")]
    known = replaced.groupBy("doc_id", F.trim("text").alias("text")).agg(F.max(F.struct("confidence", "pii_type", "surrogate", *[c for c in same if c not in ("confidence", "pii_type", "surrogate")])).alias("r"))
    more = hits.join(known, ["doc_id", "text"]).select(*hits.columns, F.lit("rewrite.survivor").alias("detector"), *[F.col("r")[c].alias(c) for c in same])
    return replaced.unionByName(keep(more, "more"))


def write_stats(replaced: DataFrame) -> DataFrame:
    return replaced.agg(
        F.count("*").alias("spans_replaced"), F.count_distinct("doc_id", "key").alias("segments_modified"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters_removed"), F.coalesce(F.sum(F.length("surrogate")), F.lit(0)).alias("characters_inserted"),
    )


def audit_log(segments: DataFrame, replaced: DataFrame) -> DataFrame:
    """One row for each replacement; whoever writes it puts it in the order of doc_id, seq, start."""
    where = segments.select("doc_id", "key", "seq", "location", "section", "column_header")
    rows = replaced.join(where, list(KEY))
    return rows.select("location", "section", "column_header", "pii_type", "detector", F.format_number("confidence", 2).alias("confidence"), "start", "end", F.col("text").alias("original"), "surrogate", "doc_id", "seq")


def mapping(replaced: DataFrame) -> DataFrame:
    """Distinct entities and their surrogates."""
    whole = replaced.groupBy("scope", "pii_type", "canonical_key").agg(F.max("canonical_text").alias("original"), F.max_by("surrogate", F.struct(F.length("text"), "text")).alias("surrogate"))
    return whole.select("scope", "pii_type", "original", "surrogate")


def rewrite_runs(runs: DataFrame, replaced: DataFrame) -> DataFrame:
    """Runs (key, run_ix, start, end, run_text) with replacements applied: the surrogate goes
    wholly into the first run that a span touches, its characters leave the others.
    A range join within the segment, then a fold for each run."""
    s = replaced.select(*KEY, F.col("start").alias("s"), F.col("end").alias("e"), "surrogate")
    met = runs.join(s, list(KEY), "left").where("s is null or (s < end and start < e)")
    # runs that meet no span fall out of the join above and come back below
    first = F.row_number().over(Window.partitionBy(*KEY, "s", "e").orderBy("run_ix")) == 1
    part = met.where("s is not null").withColumn("first", first).select(
        *KEY, "run_ix", F.struct((F.greatest("s", "start") - F.col("start")).alias("start"), (F.least("e", "end") - F.col("start")).alias("end"), F.when(F.col("first"), F.col("surrogate")).otherwise("").alias("surrogate")).alias("p")
    )
    plans = part.groupBy(*KEY, "run_ix").agg(F.array_sort(F.collect_list("p")).alias("plan"))
    empty = F.array().cast("array<struct<start:int,end:int,surrogate:string>>")
    return runs.join(plans, [*KEY, "run_ix"], "left").withColumn("new_text", splice(F.col("run_text"), F.coalesce("plan", empty))).drop("plan")
