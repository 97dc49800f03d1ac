"""Sinks and readers of reports: CSV, JSON, JSON lines and one HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; values may hold quotes and line feeds."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, such as metrics or a run's report."""
    return spark.read.option("multiLine", True).json(path)


GOLD = "key string, stratum string, location string, text string, spans array<struct<pii_type:string,start:int,end:int,text:string>>"


def read_gold(spark: SparkSession, path: str, sample: DataFrame | None = None) -> DataFrame:
    """A labelled corpus in JSON lines, with table, row and column from its location, and
    the kind and column header that the sample gives its keys (null without one)."""
    rows = spark.read.schema(GOLD).json(path)
    at = lambda word: F.nullif(F.regexp_extract("location", rf"(?i)\b{word}\s+(\d+)", 1), F.lit("")).cast("int")
    rows = rows.select("*", at("table").alias("table_index"), at("row").alias("row_index"), at("col(?:umn)?").alias("col_index"))
    if sample is None:
        return rows.withColumn("kind", F.lit(None).cast("string")).withColumn("column_header", F.lit(None).cast("string"))
    return rows.join(sample.select("key", "kind", "column_header"), "key", "left")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def metrics_json(scores: DataFrame) -> DataFrame:
    """Scores of all types as one JSON text."""
    row = F.struct("pii_type", "tp", "fp", "fn", "precision", "recall", "f1")
    return scores.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("metrics"))


def corpus_of(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Labelled corpus rows: each text with its sorted spans, none for clean texts."""
    s = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type", "text"))).alias("s"))
    empty = F.array().cast("array<struct<start:int,end:int,pii_type:string,text:string>>")
    shaped = F.transform(F.coalesce("s", empty), lambda x: F.struct(x["pii_type"].alias("pii_type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    return texts.join(s, "key", "left").select("key", "text", shaped.alias("spans"))


def dashboard(top: DataFrame, scores: DataFrame) -> str:
    """One page with the scores and the longest originals of each type (bounded by the
    number of types, times the rank limit of ``top``)."""
    data = {"scores": [r.asDict() for r in scores.collect()], "top": [r.asDict() for r in top.collect()]}
    rows = "".join(f"<tr><td>{html.escape(str(r['pii_type']))}</td><td>{r['precision']}</td><td>{r['recall']}</td><td>{r['f1']}</td></tr>" for r in data["scores"])
    payload = json.dumps(data, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset='utf-8'><title>Scores</title><table><tr><th>type</th><th>precision</th><th>recall</th><th>F1</th></tr>{rows}</table><script type='application/json' id='data'>{payload}</script>"
