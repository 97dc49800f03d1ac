"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches.  A batch's lines are counted, one for each document, and
sorted by hash.  The batch is merge-anti-joined with the runs: hashes that no run holds
become a run of their own, so every hash stands in exactly one run; hashes that some run
holds already become a tally, which adds to that run's counts.  A level that is full is
compacted: its runs are merged, its tallies are summed, and both go one level up."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import cut, drop_cut, rows_of, union, with_key

BLANK = b" \t\n\x0b\x0c\r"
MIN_DOCUMENTS = 10
BATCHES = 4
FANOUT = 3
#: A line with this share of all (document, line) pairs is hot.  There are at most so many
#: of them, and only they are broadcast; any other line is a small part of a shuffle.
HOT = 1000


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def digest(key: bytes) -> bytes:
    """128 bits."""
    return xxhash.xxh3_128_digest(key)


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_rows(docs: DataFrame, batches: int) -> DataFrame:
    """``batch, k1, k2, h``: the distinct line keys of each document, empty ones left out."""
    def part(chunks):
        for chunk in rows_of(chunks):
            out: list[tuple] = []
            for k1, k2, t in zip(chunk.column("k1").to_pylist(), chunk.column("k2").to_pylist(), chunk.column("text"), strict=True):
                out += [(k1 % batches, k1, k2, digest(k)) for k in {key_of(x) for x in lines_of(t.as_py())} if k]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["batch", "k1", "k2", "h"])

    return with_key(docs, "text").mapInArrow(part, "batch int, k1 long, k2 long, h binary")


def sorted_run(counts: DataFrame, tag: str) -> DataFrame:
    """A written run, sorted by hash."""
    return cut(counts.repartition("h").sortWithinPartitions("h"), tag)


class Runs:
    """``levels[i]`` holds up to ``fanout`` pairs (run, tally) of written tables ``h, n``.
    No hash is in two runs; a tally's hashes are all in runs of its level or above."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[tuple[DataFrame, DataFrame]]] = []

    def tables(self) -> list[tuple[DataFrame, DataFrame]]:
        return [x for level in self.levels for x in level]

    def add(self, batch: DataFrame) -> None:
        """``h``, one row for each document that has the line."""
        counts = sorted_run(batch.groupBy("h").agg(F.count("*").alias("n")), "batch")
        if not self.tables():
            self.put(0, counts, cut(counts.limit(0), "tally"))
            return
        known = union([run.select("h") for run, _ in self.tables()]).hint("merge")
        fresh = sorted_run(counts.join(known, "h", "left_anti"), "run")
        tally = sorted_run(counts.join(known, "h", "left_semi"), "tally")
        drop_cut(counts)
        self.put(0, fresh, tally)

    def put(self, level: int, run: DataFrame, tally: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, tally))
        if len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        whole = sorted_run(union([r for r, _ in old]), "run")
        total = sorted_run(union([t for _, t in old]).groupBy("h").agg(F.sum("n").alias("n")), "tally")
        for pair in old:
            for table in pair:
                drop_cut(table)
        self.put(level + 1, whole, total)

    def counts(self) -> DataFrame:
        """``h, n`` over all that was added."""
        return union([x for pair in self.tables() for x in pair]).groupBy("h").agg(F.sum("n").alias("n"))


def frequent_lines(rows: DataFrame, threshold: int, batches: int) -> DataFrame:
    """``h, n`` of the lines that reach the threshold."""
    runs = Runs()
    for i in range(batches):
        runs.add(rows.where(F.col("batch") == i).select("h"))
    return runs.counts().where(F.col("n") >= threshold)


def holders(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of frequent lines.  Lines that hold a thousandth of all rows, of which
    there are a thousand at most, are broadcast; the others are joined by a shuffle in
    which no line is large."""
    limit = max(1, rows.count() // HOT)
    hot = F.broadcast(frequent.where(F.col("n") >= limit).select("h"))
    rest = frequent.where(F.col("n") < limit).select("h")
    return rows.join(hot, "h", "left_semi").unionAll(rows.join(hot, "h", "left_anti").join(rest, "h", "left_semi"))


def dedup(docs: DataFrame, threshold: int = MIN_DOCUMENTS, batches: int = BATCHES, text: bool = True) -> DataFrame:
    """One row for each document: doc_id, number of lines, of dropped ones, SHA-256 of the
    rest, and with ``text`` the rest itself as ``kept``.  Null and empty texts are one
    empty line, which stays.  Repeated rows are documents of their own.  An empty table
    gives no rows."""
    rows = cut(line_rows(docs, batches), "keys", "batch")
    frequent = cut(frequent_lines(rows, threshold, batches), "frequent")
    drops = holders(rows.select("k1", "k2", "h"), frequent).groupBy("k1", "k2").agg(F.collect_set("h").alias("drop"))
    texts = with_key(docs, "doc_id", "text").join(drops, ["k1", "k2"], "left").select("doc_id", "text", "drop")

    def part(chunks):
        for chunk in rows_of(chunks, 64):
            n_lines, n_dropped, kept = [], [], []
            for t, drop in zip(chunk.column("text"), chunk.column("drop").to_pylist(), strict=True):
                lines = lines_of(t.as_py())
                gone = set(drop or ())
                stay = [x for x in lines if not (k := key_of(x)) or digest(k) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            columns = [chunk.column("doc_id").cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if text:
                columns.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(part, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * text)
