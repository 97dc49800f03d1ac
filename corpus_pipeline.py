"""The training-corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), where ``docs`` is a written table with the
columns of ``documents``, and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontam, langid, mixing, sharding, simhash
from spanveil.llm.common import cut, drop_cut, table

#: A text that costs more bits a byte than this under every language is not language:
#: an even guess costs 6 and random letters more, clean text of a known language about 2.
REJECT_BITS = 7.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and those that no learned
    language explains; if no row has a language, all.  Repeated rows stay."""
    found = langid.identify(docs, keep=tuple(docs.columns)).where((F.col("lang_pred") != langid.NONE) & (F.col("bits_per_byte") <= REJECT_BITS))
    return found.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id (null
    ids come last); null and wordless texts are copies of each other."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item, or a whole shorter
    item.  Texts without words and an empty benchmark drop nothing; rows alike go together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets; a null source
    is one too.  Rows alike in id and text are taken equally often."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the slot and the shard of each document, by its id; a null id has a shard too."""
    return sharding.place(docs)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Neither trained language models nor fingerprint groups can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
