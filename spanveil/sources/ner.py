"""Entities of an external model as a source of spans.

A model is not part of the engine: its output is a table ``doc_id, key, start, end, text,
label`` from any batch job, cached and reused like any other table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.operators.detectors import NAME, looks_like_person

LABELS = ("PERSON", "ORG", "GPE", "LOC", "FAC", "DATE", "NORP")
SCHEME = r"(?i)\b(?:scheme|plan|yojana|fund|programme|mission|bond|scholarship)\b"
CONFIDENCE = 0.80


def ner_spans(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """PERSON entities that look like a name, cut to their leading name, unless the 36
    characters after them speak of a scheme."""
    lead = F.regexp_extract("text", rf"(?U)^{NAME}", 0)
    people = entities.where("label = 'PERSON'").select("doc_id", "key", "start", lead.alias("name")).where("name <> ''")
    met = people.join(segments.select("doc_id", "key", F.col("text").alias("segment")), ["doc_id", "key"])
    end = F.col("start") + F.length("name")
    kept = met.where(looks_like_person(F.col("name")) & ~F.substring(F.col("segment"), end + 1, F.lit(36)).rlike(SCHEME))
    return kept.select("doc_id", "key", F.col("start").cast("int").alias("start"), end.cast("int").alias("end"), F.col("name").alias("text"), F.lit("PERSON").alias("pii_type"), F.lit("person.ner").alias("detector"), F.lit(CONFIDENCE).alias("confidence"))
