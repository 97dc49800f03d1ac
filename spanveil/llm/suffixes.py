"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only suffixes that can share their first THRESHOLD bytes with another are sorted.  Each
window of that many bytes is dealt by its anchor, the piece of PIECE bytes in it with
the smallest hash, so equal windows have equal anchors.  Neighbouring windows with the
same anchor travel as one stretch; equal stretches of a task travel once.  Where an
anchor occurs once in the whole corpus, none of its windows repeats.  An anchor that
occurs very often is dealt in slices, by how far it stands from the window's start, which
equal windows share too.

The windows of an anchor are ordered by most-significant-digit passes.  A digit is eight
bytes, read as one big-endian number: a pass orders each group of the pass before by the
next digit, makes a group of each digit, and drops groups of one.  What is left after
the last digit are exactly the repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import cut, rows_of, with_key

THRESHOLD = 200
PIECE = 32
#: Bytes of a digit, and windows that are sorted at once.
DIGIT = 8
AT_ONCE = 4_000_000
#: An anchor with so many occurrences is dealt in slices of so many window starts.
HOT, SLICE = 500, 32
#: Bytes of distinct stretches that a task gathers before it passes them on, or sorts them.
GATHER = 8 << 20
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def octets(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(np.uint64).ravel()


def anchors_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and how often each one's piece stands in the text: in a text of
    short period it does so more than once inside one stretch."""
    anchor, _, _, hashes = stretches(data)
    known = np.unique(anchor)
    marked = np.zeros(1 << 16, bool)
    marked[known & 0xFFFF] = True
    found, n = np.unique(hashes[marked[hashes & 0xFFFF]], return_counts=True)
    return known, n[np.searchsorted(found, known)] if len(known) else known


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each stretch, in order, and the hash of
    the piece at each place."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < THRESHOLD:
        return none, none, none, none
    raw = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)[:n]).view(np.uint64).ravel()
    m, width = n - PIECE + 1, THRESHOLD - PIECE + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for i in range(PIECE // 8):
            h ^= words[8 * i : 8 * i + m] * MIX[i] + (h >> np.uint64(29))
        h *= MIX[4]
        h ^= h >> np.uint64(32)
    # smallest hash of each run of ``width``: the suffix of one block and the prefix of the next
    blocks = np.concatenate([h, np.full(-m % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - THRESHOLD + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first].view(np.int64), first, np.diff(np.append(first, count)), h.view(np.int64)


def anchor_rows(rows: DataFrame) -> DataFrame:
    """``k1, k2, anchor, n``: distinct anchors of each document and their occurrences."""
    def part(batches):
        for batch in rows_of(batches):
            k1, k2, anchors, ns = [], [], [], []
            for a, b, t in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                found, n = anchors_in((t.as_py() or "").encode("utf-8", "surrogatepass"))
                k1.append(np.full(len(found), a, np.int64))
                k2.append(np.full(len(found), b, np.int64))
                anchors.append(found)
                ns.append(n)
            join = lambda x: pa.array(np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([join(k1), join(k2), join(anchors), join(ns)], names=["k1", "k2", "anchor", "n"])

    return rows.mapInArrow(part, "k1 long, k2 long, anchor long, n long")


def slices(first: int, n: int, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice, first window, number of windows) of one stretch, whose anchor stands at the
    places.  The slice of a window is told by how far on its first anchor is."""
    at = np.arange(first, first + n)
    number = (places[np.searchsorted(places, at)] - at) // SLICE
    edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(number[s]), first + s, e - s


def stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their repeated anchors -> ``anchor, slice, data, k1, k2, first``, the
    last three as lists of the places where the stretch occurs."""
    held: dict[tuple[int, int, bytes], tuple[list, list, list]] = {}
    size = 0
    types = [pa.int64(), pa.int32(), pa.binary()] + 3 * [pa.list_(pa.int64())]

    def flush() -> pa.RecordBatch:
        columns = [[k[0] for k in held], [k[1] for k in held], [k[2] for k in held], *([v[i] for v in held.values()] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "slice", "data", "k1", "k2", "first"])

    for batch in rows_of(batches, 32):
        for k1, k2, t, wanted, hot in zip(*(batch.column(c).to_pylist() if c != "text" else batch.column(c) for c in ("k1", "k2", "text", "anchors", "hot")), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            anchor, first, n, hashes = stretches(data)
            hot = set(hot)
            for i in np.flatnonzero(np.isin(anchor, np.array(wanted, np.int64))).tolist():
                a, s, c = int(anchor[i]), int(first[i]), int(n[i])
                if a in hot:
                    parts = slices(s, c, s + np.flatnonzero(hashes[s : s + c + THRESHOLD - PIECE] == a))
                else:
                    parts = ((0, s, c),)
                for number, start, count in parts:
                    key = a, number, data[start : start + count + THRESHOLD - 1]
                    places = held.get(key)
                    if places is None:
                        places = held[key] = [], [], []
                        size += len(key[2])
                    for column, value in zip(places, (k1, k2, start)):
                        column.append(value)
                    size += 24
        if size >= GATHER:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def radix(data: np.ndarray, at: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the windows at ``at`` equal another of their group, or stand for several."""
    alive = np.argsort(group, kind="stable")
    first = np.concatenate([[True], np.diff(group[alive]) != 0])[: len(alive)]  # of its group
    for start in range(0, THRESHOLD, DIGIT):
        if not len(alive):
            break
        digit = octets(data, at[alive] + start).byteswap()
        number = np.cumsum(first) - 1
        differs = ~first & np.concatenate([[False], digit[1:] != digit[:-1]])
        if differs.any():  # groups of one digit throughout are in order
            mixed = np.zeros(number[-1] + 1, bool)
            mixed[number[differs]] = True
            part = np.flatnonzero(mixed[number])
            order = part[np.lexsort((digit[part], number[part]))]
            alive[part], digit[part] = alive[order], digit[order]
            first[1:] |= digit[1:] != digit[:-1]
        edge = np.flatnonzero(first)
        keep = np.repeat(np.add.reduceat(weight[alive], edge) > 1, np.diff(np.append(edge, len(alive))))
        alive, first = alive[keep], first[keep]
    out = np.zeros(len(at), bool)
    out[alive] = True
    return out


def repeated(groups: np.ndarray, counts: np.ndarray, texts: list[bytes], n: np.ndarray) -> list[np.ndarray]:
    """For distinct stretches (their anchor's number, how often each occurs, bytes, number
    of windows): which windows repeat."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    owner = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(owner), bool)
    rounds = -(-len(owner) // AT_ONCE)
    turn = np.zeros(len(owner), np.int64)
    if rounds > 1:  # equal windows have equal first digits, and so the same turn
        for s in range(0, len(owner), AT_ONCE):
            part = slice(s, s + AT_ONCE)
            with np.errstate(over="ignore"):
                turn[part] = ((octets(data, starts[owner[part]] + offset[part]) * MIX[1]) >> np.uint64(40)) % np.uint64(rounds)
    for r in range(rounds):
        pick = np.flatnonzero(turn == r)
        own = owner[pick]
        out[pick] = radix(data, starts[own] + offset[pick], groups[own], counts[own])
    return np.split(out, np.cumsum(n)[:-1])


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that flagged windows cover."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + THRESHOLD - 1
    if not len(start):
        return start, stop
    apart = start[1:] > stop[:-1]
    return start[np.concatenate([[True], apart])], stop[np.concatenate([apart, [True]])]


def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by anchor and slice -> ``k1, k2, start, stop`` of covered bytes.
    Equal stretches are held once, with the places where they occur."""
    held: dict[tuple[int, int, bytes], list[tuple[list, list, list]]] = {}
    size = 0

    def solve() -> pa.RecordBatch:
        keys, places = list(held), list(held.values())
        counts = np.array([sum(len(p[0]) for p in x) for x in places])
        n = np.array([len(k[2]) - THRESHOLD + 1 for k in keys], np.int64)
        group = np.cumsum([i > 0 and keys[i][:2] != keys[i - 1][:2] for i in range(len(keys))])
        # a stretch that occurs twice repeats as a whole; where all do, nothing is left to sort
        open_ = np.flatnonzero((np.bincount(group, weights=counts == 1) > 0)[group])
        flags: dict[int, np.ndarray] = {}
        if len(open_):
            for i, f in zip(open_, repeated(group[open_], counts[open_], [keys[i][2] for i in open_], n[open_]), strict=True):
                flags[int(i)] = f
        out: list[tuple[int, int, int, int]] = []
        for i, k in enumerate(keys):
            if counts[i] > 1:
                spans = [(0, len(k[2]))]
            elif i in flags:
                spans = list(zip(*(x.tolist() for x in runs_of(flags[i])), strict=True))
            else:
                spans = []
            out += [(k1, k2, first + s, first + e) for p in places[i] for k1, k2, first in zip(*p, strict=True) for s, e in spans]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "stop"])

    last = None
    for batch in rows_of(batches, 4096):
        for anchor, number, data, *places in zip(*(batch.column(c).to_pylist() for c in ("anchor", "slice", "data", "k1", "k2", "first")), strict=True):
            if (anchor, number) != last and size >= GATHER:
                yield solve()
                held.clear()
                size = 0
            last = anchor, number
            key = anchor, number, data
            if key not in held:
                held[key] = []
                size += len(data)
            held[key].append(places)
    if held:
        yield solve()


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, 64):
        out: list[tuple] = []
        for doc_id, t, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            kept, end, runs = [], 0, 0
            for s in spans or ():
                if s["start"] > end or not runs:
                    kept.append(data[end : s["start"]])
                    runs += 1
                end = max(end, s["stop"])
            kept = b"".join([*kept, data[end:]])
            out.append((doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: bytes, bytes removed, maximal removed runs, and the
    SHA-256 of the rest.  A byte goes if a string of THRESHOLD bytes over it starts
    anywhere else too, judged on the input.  Null texts are empty; texts shorter
    than the threshold lose nothing; repeated rows repeat each other."""
    rows = with_key(docs, "doc_id", "text")
    anchors = cut(anchor_rows(rows.select("k1", "k2", "text")), "anchors")
    common = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", F.when(F.col("n") >= HOT, F.col("anchor")).alias("hot"))
    wanted = anchors.select("k1", "k2", "anchor").join(common, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("hot").alias("hot"))
    # with doc_id, so that the texts are dealt by their keys once for both joins
    pieces = rows.join(wanted, ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "anchors", "hot").mapInArrow(stretch_rows, "anchor long, slice int, data binary, k1 array<long>, k2 array<long>, first array<long>")
    found = pieces.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice").mapInArrow(sort_groups, "k1 long, k2 long, start long, stop long")
    spans = found.distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(remove, SCHEMA)
