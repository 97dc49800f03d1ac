"""Near-duplicates by SimHash with bit-sliced comparison.

Fingerprints go to buckets by some of their bits.  The rows of buckets are stored as bit
planes, one machine word holding one bit of 64 fingerprints; a comparison runs down the
planes, carry-save counters add up 64 distances at once, and blocks are given up as soon
as all their distances exceed the radius.

For a similarity, pairs of close fingerprints are compared by their whole sets of
shingles.  What fingerprints cannot tell is found exactly: in one order of all shingles,
two alike sets share one of their first few, which are further buckets."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from spanveil.llm.common import cut, drop_cut, packed, rows_of, union, unpacked
from spanveil.llm.components import components

SEED = 42
#: The 64-bit query: shingles of three words, two bits of difference.
WIDTH, RADIUS = 3, 2
#: Near-duplicates by similarity: shingles of five words, 0.8 or more.
SIMILAR_WIDTH, SIMILARITY = 5, 0.8
SMALL = 64
#: Fingerprints of distinct shingles that are linked before sets are looked for otherwise.
FIRST_RADIUS = 3
CHUNK = 1 << 18
#: Texts of the sample that tells common shingles, and how many of these are kept.  They
#: set the order of shingles, which decides how much is compared and not what is found.
SAMPLE, COMMON = 10_000, 200_000
#: Products of the similarity and a count may be off by so much.
ROUND = 1e-9


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included.  A-Z is lower-cased; words are split at
    ASCII white space; fewer words than ``width`` are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s : e - 1], SEED) for s, e in zip(starts, starts[width:])), np.uint64, n - width + 1)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, print``."""
    def part(batches):
        for batch in rows_of(batches):
            prints = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(part, "doc_id long, print long")


ALL = ~np.uint64(0)
#: Planes that are added up before blocks are given up.
STRIDE = 8


class Planes:
    """Fingerprints laid out vertically: ``rows[b]`` holds bit b of all of them, 64 to a word."""

    def __init__(self, prints: np.ndarray) -> None:
        self.n, self.blocks = len(prints), -(-len(prints) // 64)
        padded = np.zeros(self.blocks * 64, np.uint64)
        padded[: self.n] = prints
        bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(self.blocks, 64, 8), axis=2, bitorder="little")
        words = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
        self.rows = np.concatenate([words, np.zeros((64, 1), words.dtype)], axis=1).astype(np.uint64)

    def mask(self, wanted: np.ndarray) -> np.ndarray:
        """Booleans of the fingerprints as one bit of each word."""
        padded = np.zeros(self.blocks * 64, np.uint8)
        padded[: len(wanted)] = wanted
        return np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)

    def within(self, other: Callable[[int, np.ndarray], np.ndarray], wanted: np.ndarray, radius: int) -> np.ndarray:
        """Which of the wanted fingerprints differ in at most ``radius`` bits from what
        ``other(bit, blocks)`` gives for them.

        Bits that differ are added up by carry-save counters, one bit of the count in each
        word.  After every STRIDE planes, blocks whose 64 counts all exceed the radius,
        or were not wanted, are given up."""
        mask = self.mask(wanted)
        block = np.flatnonzero(mask)
        over = ~mask[block]
        counters = [np.zeros(len(block), np.uint64) for _ in range(radius.bit_length())]
        for first in range(0, 64, STRIDE):
            for bit in range(first, first + STRIDE):
                carry = self.rows[bit, block] ^ other(bit, block)
                for k, c in enumerate(counters):
                    counters[k], carry = c ^ carry, c & carry
                over |= carry
            same = np.full(len(block), ALL)  # comparison with the radius, from the highest digit down
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    same = same & counters[k]
                else:
                    over |= same & counters[k]
                    same = same & ~counters[k]
            left = over != ALL
            if not left.all():
                block, over, counters = block[left], over[left], [c[left] for c in counters]
            if not len(block):
                break
        out = np.zeros(self.blocks, np.uint64)
        out[block] = ~over
        return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little")[: self.n].astype(bool)

    def near(self, print_: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Which of the wanted ones are within the radius of one fingerprint."""
        return self.within(lambda bit, block: ALL if print_ >> bit & 1 else np.uint64(0), wanted, radius)

    def ahead(self, step: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Which of the wanted ones are within the radius of the one ``step`` places on."""
        whole, part = divmod(step, 64)

        def other(bit: int, block: np.ndarray) -> np.ndarray:
            low = self.rows[bit, np.minimum(block + whole, self.blocks)]
            if not part:
                return low
            high = self.rows[bit, np.minimum(block + whole + 1, self.blocks)]
            return low >> np.uint64(part) | high << np.uint64(64 - part)

        return self.within(other, wanted, radius)


def small_links(prints: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small buckets at once; equal bucket numbers stand together."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    planes = Planes(prints)
    for step in range(1, SMALL):
        wanted = bucket[:-step] == bucket[step:]
        if not wanted.any():
            break
        i = np.flatnonzero(planes.ahead(step, wanted, radius))
        left.append(i)
        right.append(i + step)
    return np.concatenate(left), np.concatenate(right)


def large_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all pairs of one large bucket would connect.

    All within the radius of a centre hang on it and need not be compared with each
    other.  What is farther can only be near one of them if it is within twice the
    radius of the centre, and only that is compared with them."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    planes, rest = Planes(prints), np.ones(len(prints), bool)
    for centre in range(len(prints)):
        if not rest[centre]:
            continue
        rest[centre] = False
        own = planes.near(int(prints[centre]), rest, radius)
        rest &= ~own
        if not own.any():
            continue
        left.append(np.full(own.sum(), centre))
        right.append(np.flatnonzero(own))
        for j in np.flatnonzero(planes.near(int(prints[centre]), rest, 2 * radius)):
            found = np.flatnonzero(planes.near(int(prints[j]), own, radius))[:1]
            left.append(found)
            right.append(np.full(len(found), j))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, print) sorted by bucket -> links (a, b) of nodes."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        bucket, node, prints = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        size = np.diff(edge)
        each = np.repeat(size, size)
        pick = np.flatnonzero((each > 1) & (each <= SMALL))
        i, j = small_links(prints[pick], bucket[pick], radius)
        a, b = [pick[i]], [pick[j]]
        for k in np.flatnonzero(size > SMALL):
            i, j = large_links(prints[edge[k] : edge[k + 1]], radius)
            a.append(edge[k] + i)
            b.append(edge[k] + j)
        return pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(a)]), pa.array(node[np.concatenate(b)])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        last = held[-1][-1, 0]
        if sum(map(len, held)) >= 100_000 and held[-1][0, 0] != last:
            rows = np.concatenate(held)
            whole = len(rows) - int((held[-1][:, 0] == last).sum())
            held = [rows[whole:]]
            yield solve(rows[:whole])
    if held:
        yield solve(np.concatenate(held))


def tables(radius: int) -> list[Column]:
    """Bucket keys: ``radius`` + 2 blocks of bits, of which two at least agree in every
    pair within the radius, so no link is lost."""
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    def bits(i: int) -> Column:
        return F.shiftrightunsigned("print", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    return [F.xxhash64(F.lit(t), bits(i), bits(j)) for t, (i, j) in enumerate(itertools.combinations(range(blocks), 2))]


def link(nodes: DataFrame, radius: int) -> DataFrame:
    """``node, print`` -> links ``a, b``.  Buckets are sorted, not collected."""
    rows = nodes.select(F.explode(F.array(*tables(radius))).alias("bucket"), "node", "print")
    near = rows.repartition("bucket").sortWithinPartitions("bucket")
    return near.mapInArrow(lambda batches: bucket_links(batches, radius), "a long, b long")


def group(prints: DataFrame, radius: int) -> DataFrame:
    """``print`` -> ``print, root``: distinct fingerprints and their component."""
    nodes = prints.select("print").distinct().select(F.col("print").alias("node"), "print")
    roots = components(link(nodes, radius))
    return nodes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("root"))


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """``node, text`` -> ``node, shingles``: the distinct hashes, sorted, as bytes."""
    def part(batches):
        for batch in rows_of(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(part, "node long, shingles binary")


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sets have at least that Jaccard similarity; two empty ones do."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def verify(pairs: DataFrame, kept: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The ``a, b`` of pairs whose ``kept`` values pass.  The test is the same both ways,
    so the two values are the least and the greatest of a pair."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(kept.toDF("node", "kept"), "node")
    rows = ends.groupBy("a", "b").agg(F.min("kept").alias("x"), F.max("kept").alias("y"))

    def part(batches):
        for batch in rows_of(batches):
            good = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(part, "a long, b long")


def classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, its 64-bit fingerprint in hexadecimal, and the
    smallest doc_id of its component (null if all in it are null).  Null and empty
    texts have fingerprint zero and are linked like any other; an empty table gives no
    rows; repeated rows are one node."""
    prints = cut(fingerprints(docs, width), "prints")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    named = cut(group(prints, radius).join(least, "print"), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select("print", "component_id")
    return prints.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found more than once in a sample of the texts, sorted, and how often: the most
    frequent ones, COMMON at most."""
    share = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(share)) == 0).select("text")

    def part(batches):
        for batch in rows_of(batches):
            found = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    counts = cut(some.mapInArrow(part, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # the least count that at most COMMON shingles reach; few different counts are met
    least, left = 2, COMMON
    for n, shingles in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        left -= shingles
        if left < 0:
            least = n + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    drop_cut(counts)
    shingle, n = (found.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle.view(np.uint64))
    return shingle.view(np.uint64)[order], n[order]


def prefix(h: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a set of which two sets of that similarity share at least one, in an
    order that all sets share: the less common ones first."""
    n = np.zeros(len(h), np.int64)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        n = np.where(known[0][at] == h, known[1][at], 0)
    return h[np.argsort(n, kind="stable")[: len(h) - math.ceil(similarity * len(h) - ROUND) + 1]]


def parity(h: np.ndarray) -> bytes:
    """The size of a set, and bits of which each one tells whether an odd number of its
    members fall on it; about as many bits as members."""
    bits = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.int64(len(h)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether the parities of two sets show that they are less alike: in as many bits as
    differ, at least one member is in one set only."""
    n = sum(int(np.frombuffer(z, np.int64, 1)[0]) for z in (x, y))
    a, b = (np.frombuffer(z, np.uint64, offset=8) for z in (x, y))
    words = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, words), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum()) > n * (1 - similarity) / (1 + similarity) + ROUND


def prefixes(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``k1, k2, doc_id, node, n, print, prefix, parity``: node is the hash of the set of n
    shingles, print their fingerprint."""
    known = rows.sparkSession.sparkContext.broadcast(common(rows, width))

    def part(batches):
        for batch in rows_of(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column("text")]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64)
            prints = np.array([fingerprint(h) for h in sets], np.uint64)
            first = [prefix(h, known.value, similarity).view(np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("doc_id").cast(pa.int64()), pa.array(node.view(np.int64)), pa.array([len(h) for h in sets], pa.int64()), pa.array(prints.view(np.int64)), pa.array(first, pa.list_(pa.int64())), pa.array([parity(h) for h in sets], pa.binary())],
                names=["k1", "k2", "doc_id", "node", "n", "print", "prefix", "parity"],
            )

    return rows.select("k1", "k2", "doc_id", "text").mapInArrow(part, "k1 long, k2 long, doc_id long, node long, n long, print long, prefix array<long>, parity binary")


def possible(rows: np.ndarray, i: np.ndarray, k: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows i and k > i of one bucket may be alike by their sizes and, if their
    shingle is the first they share, by what can still follow it."""
    n, pos = rows[:, 1], rows[:, 3]
    least = np.ceil(similarity / (1 + similarity) * (n[i] + n[k]) - ROUND)
    return (n[i] >= similarity * n[k] - ROUND) & (np.minimum(n[i] - pos[i], n[k] - pos[k]) >= least)


def matched(rows: np.ndarray, first: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows have any possible partner in their bucket; rows are sorted by size."""
    n, found, step = rows[:, 1], np.zeros(len(rows), bool), 0
    up = down = np.arange(len(rows))
    while len(up) or len(down):
        step += 1
        up = up[(up + step < last[up]) & ~found[up]]
        up = up[n[up] >= similarity * n[up + step] - ROUND]
        down = down[(down - step >= first[down]) & ~found[down]]
        down = down[n[down - step] >= similarity * n[down] - ROUND]
        i, k = np.concatenate([up, down - step]), np.concatenate([up + step, down])
        good = possible(rows, i, k, similarity)
        found[i[good]] = found[k[good]] = True
    return found


def spans(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the buckets begin, and their sizes."""
    edge = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(rows)))


def partners(rows: np.ndarray, low: int, high: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (shingle, n, node, pos, root), sorted.  Those of buckets that are not settled, and
    pairs of them, at least ``low`` and at most ``high`` rows apart, that may be alike
    and have different roots.  Rows without a possible partner go first, which they do
    in every round alike, so that distances stay.  A pair passes in the bucket of the first
    shingle it shares.  One of two different roots is not the most frequent one."""
    edge, size = spans(rows)
    rows = rows[np.repeat(size > 1, size)]
    edge, size = spans(rows)
    rows = rows[matched(rows, np.repeat(edge, size), np.repeat(edge + size, size), similarity)]
    edge, size = spans(rows)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return rows, none, none
    unsettled = (size > low) & (np.minimum.reduceat(rows[:, 4], edge) != np.maximum.reduceat(rows[:, 4], edge))
    rows = rows[np.repeat(unsettled, size)]
    edge, size = spans(rows)
    if not len(rows):
        return rows, none, none
    bucket, first, last = (np.repeat(x, size) for x in (np.arange(len(size)), edge, edge + size))
    root = rows[:, 4]
    order = np.lexsort((root, bucket))
    run = np.flatnonzero(np.concatenate([[True], (np.diff(root[order]) != 0) | (np.diff(bucket[order]) != 0)]))
    best = np.lexsort((np.diff(np.append(run, len(rows))), bucket[order[run]]))
    most = np.repeat(root[order[run[best[np.cumsum(np.bincount(bucket[order[run]])) - 1]]]], size)
    a, b = [none], [none]
    left = np.flatnonzero(root != most)
    for step in range(low, high + 1):
        left = left[(left + step < last[left]) | (left - step >= first[left])]
        if not len(left):
            break
        back = left[left - step >= first[left]] - step
        i = np.concatenate([left[left + step < last[left]], back[root[back] == most[back]]])
        k = i + step
        good = (root[i] != root[k]) & possible(rows, i, k, similarity)
        a.append(i[good])
        b.append(k[good])
    return rows, np.concatenate(a), np.concatenate(b)


def propose(rows: DataFrame, low: int, high: int, similarity: float) -> DataFrame:
    """``shingle, n, node, pos, root`` -> those of buckets with more than one root and more
    than ``low`` rows, and ``others``, the nodes each one is to be compared with."""
    def solve(held: np.ndarray):
        rows, a, b = partners(held, low, high, similarity)
        order = np.argsort(a, kind="stable")
        edge = np.searchsorted(a[order], np.arange(len(rows) + 1)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(edge), pa.array(rows[b[order], 2]))
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, c].copy()) for c in range(4)), others], names=["shingle", "n", "node", "pos", "others"])

    def part(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held.append(np.stack(columns, axis=1))
            last = held[-1][-1, 0]
            if sum(map(len, held)) >= 100_000 and held[-1][0, 0] != last:
                now = np.concatenate(held)
                whole = len(now) - int((held[-1][:, 0] == last).sum())
                held = [now[whole:]]
                yield solve(now[:whole])
        if held:
            yield solve(np.concatenate(held))

    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    return dealt.mapInArrow(part, "shingle long, n long, node long, pos long, others array<long>")


class Alike:
    """The groups that verified pairs make.  A pair is compared by parities first, and
    only nodes of pairs that pass have their whole sets fetched."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> None:
        self.nodes, self.texts, self.width, self.similarity = nodes, texts, width, similarity
        self.sets: list[DataFrame] = []
        self.roots = cut(nodes.select("node", F.col("node").alias("root")).limit(0), "roots")

    def join(self, pairs: DataFrame) -> None:
        similarity = self.similarity
        asked = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        left = cut(verify(asked, self.nodes.select("node", "parity"), lambda x, y: not differ(x, y, similarity)), "pairs")
        drop_cut(asked)
        if not left.isEmpty():
            ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            if self.sets:
                ends = ends.join(union(self.sets).select("node"), "node", "left_anti")
            wanted = cut(self.nodes.select("node", "first.k1", "first.k2").join(ends, "node"), "wanted")
            if not wanted.isEmpty():
                self.sets.append(cut(shingle_sets(self.texts.join(wanted, ["k1", "k2"]).select("node", "text"), self.width), "sets"))
            drop_cut(wanted)
            found = verify(left, union(self.sets), lambda x, y: alike(x, y, similarity))
            known = self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = components(found.unionAll(known))
            drop_cut(self.roots)
            self.roots = roots
        drop_cut(left)

    def rooted(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def settle(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``node, n, print, prefix, parity, first`` -> ``node, root`` over all pairs of alike sets.

    Pairs of close fingerprints are joined first.  For all others: two alike sets meet in
    a bucket of a shingle.  Neighbours in a bucket are compared first; what is joined
    needs no further comparison, and the others go on with rows farther off until no
    bucket has two roots that were not compared."""
    groups = Alike(nodes, texts, width, similarity)
    groups.join(link(nodes.select("node", "print"), FIRST_RADIUS))
    rows = groups.rooted(nodes.select("node", "n", "prefix")).select("node", "n", "root", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "n", "node", "pos", "root")
    low, high, before = 1, 4, None
    while True:
        met = cut(propose(rows, low, high, similarity), "met")
        if before is not None:
            drop_cut(before)
        if met.isEmpty():
            for table in (met, *groups.sets):
                drop_cut(table)
            return groups.roots
        groups.join(met.select(F.col("node").alias("a"), F.explode("others").alias("b")))
        rows = groups.rooted(met.select("shingle", "n", "node", "pos")).select("shingle", "n", "node", "pos", "root")
        low, high, before = high + 1, 8 * high, met


def keep_one(docs: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates, all columns as they are: of every group, the
    document of the smallest id stays, null ids last.  Documents are linked if their sets
    of shingles have that similarity.  Null texts and texts without words are copies of
    each other.  Of rows that agree in doc_id and text one stays, by a hash of their other
    columns.  An empty table gives no rows."""
    rows = packed(docs)
    texts = rows.select("k1", "k2", "row.doc_id", "row.text")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(1 << 62)).alias("doc_id"), "k1", "k2"))
    nodes = prefixes(texts, width, similarity).groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("n", "print", "prefix", "parity")])
    nodes = cut(nodes, "nodes")
    roots = settle(nodes, texts.select("k1", "k2", "text"), width, similarity)
    stay = cut(nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.k1", "first.k2"), "stay")
    drop_cut(nodes)
    drop_cut(roots)
    other = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64(*other)))
    return unpacked(rows.join(stay, ["k1", "k2"], "left_semi").withColumn("place", place).where("place = 1"))
