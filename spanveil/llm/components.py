"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import cut, drop_cut, renamed

#: Links of a part that are contracted at once.
AT_ONCE = 500_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` -> links that connect the same nodes: each node with the smallest one
    that the links held at once connect it with."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, top(x)) for x in list(root) if top(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) >= AT_ONCE:
            yield stars()
            root.clear()
    if root:
        yield stars()


def _large(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest one."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _open(links: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that hangs itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    found = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not found.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links of long ids -> a written table ``node, root``: every linked node but the
    smallest of its component, with that smallest one.  Each part of the links is
    contracted by itself first; rounds grow with the logarithm of the longest chain of
    what is left.  Each round is written to the shared folder, and minima are summed up
    map-side, so a node with very many links is no hot task."""
    now = cut(links.where("a <> b").mapInArrow(contract, "a long, b long").distinct(), "links")
    while _open(now):
        then = cut(_small(_large(now).distinct()).where("a <> b").distinct(), "links")
        drop_cut(now)
        now = then
    return renamed(now, "node", "root")
