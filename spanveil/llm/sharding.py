"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots (a prime, over 100 for each shard, so that shares differ by under 1 %).
SLOTS = 1009
SHARDS = tuple(f"shard{i:02d}" for i in range(8))


def number(text: str) -> int:
    """The first 32 bits of the MD5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The table: slot -> shard.  Every shard has a permutation of the slots,
    (offset + j * skip) mod slots; shards claim in turn their next free preference.
    Taking a shard away moves its own slots and few others."""
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    owner: list[str | None] = [None] * slots
    prefs = [(number(f"offset|{s}") % slots, number(f"skip|{s}") % (slots - 1) + 1) for s in shards]
    upto = [0] * len(shards)
    for turn in range(slots):
        i = turn % len(shards)
        offset, skip = prefs[i]
        while owner[slot := (offset + upto[i] * skip) % slots] is not None:
            upto[i] += 1
        owner[slot] = shards[i]
    return owner


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard``: as many rows as slots, whatever the number of documents."""
    return spark.createDataFrame(list(enumerate(fill(shards, slots))), "slot int, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; a null key counts as an empty text."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (they replace columns of these names).

    No document moves: the table is bounded by ``slots`` and broadcast, so this is
    a map-side join.  Copies of one key go to one shard; a null key has a shard too."""
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    rows = docs.select(*kept, slot_of(F.col(key), slots).alias("slot"))
    return rows.join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "slot", "left").select(*kept, "slot", "shard")
