"""Toxicity by compression distance under two zstandard dictionaries.

Both dictionaries are trained by zstandard, on the words of toxic and of ordinary texts.
Each word of a text is a window; it is compressed with either dictionary, and the
difference of the two lengths says which kind of text it is closer to.  The ordinary
dictionary is much the larger one: what ordinary texts hold at all is in it, so only what
they lack is shorter under the toxic one.  A window counts if it is shorter by at least
a threshold, and a text is scored by how unlikely so many such windows are among as many
ordinary ones, which does not grow with the length of a text.  The size of the toxic
dictionary, the thresholds and the rate in ordinary texts are calibrated on a part of
the sample that the dictionaries were not trained on."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_of
from spanveil.llm.sampling import choose

#: The documented bound of the sample: rows for each class, and the longest text in it.
PER_CLASS = 3000
LONGEST = 20_000
#: zstandard's trainer: bytes of the pieces that it counts, of the segments that it picks
#: by them, and of the dictionaries (the ordinary one gets as many as there is use for).
PIECE = 8
SEGMENTS = (10, 11)
TOXIC_BYTES = (2048, 4096, 8192, 12288)
ORDINARY_BYTES = 400_000
LEVEL = 3
#: Thresholds are the least, by length of the window, that so large a share of ordinary
#: windows of that length reaches; the best of these shares is taken.
SHARES = (1e-5, 3e-5, 1e-4, 3e-4, 1e-3)
LEAST, LENGTHS = 3, 16
#: An ordinary text that is called toxic is as bad as so many toxic ones that are not.
ALARM = 10.0
WORD = re.compile(r"[^\W\d_]+")
#: Both dictionaries begin with these bytes and every window ends with them.  Their match
#: pays the fixed cost of a compressed block, so a short match in the window shows.
#: Compressors neither index the last bytes of a dictionary nor search those of the input.
CARRIER = bytes(range(128, 160))
PADDING = bytes(8)
CACHE = 200_000


def words_in(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window(word: str) -> bytes:
    return f"  {word}  ".encode()


def trained(texts: list[list[str]], size: int, segment: int) -> bytes:
    """What zstandard picks from the windows of the texts; nothing if they are too few."""
    try:
        return zstandard.train_dictionary(size, [window(w) for t in texts for w in t], k=segment, d=PIECE).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(content: bytes):
    whole = zstandard.ZstdCompressionDict(CARRIER + content + PADDING, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    whole.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=whole, write_content_size=False, write_checksum=False, write_dict_id=False).compress


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    thresholds: tuple[int, ...] = ()  # by length of the window
    rate: float = 0.0  # of windows that count in ordinary texts
    cut: float = 0.0
    prior: float = 0.0  # the score if there is nothing to compare with

    def start(self) -> Model:
        self.known: dict[str, tuple[int, int]] = {}
        self.pair = compressor(self.ordinary), compressor(self.toxic)
        return self

    def difference(self, word: str) -> tuple[int, int]:
        """The length of a window, up to LENGTHS, and the bytes that the toxic dictionary saves."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            data = window(word)
            lengths = [len(f(data + CARRIER)) for f in self.pair]
            got = self.known[word] = min(len(data), LENGTHS), lengths[0] - lengths[1]
        return got

    def counts(self, text: str | None) -> Counter:
        return Counter(map(self.difference, words_in(text)))

    @staticmethod
    def surprise(found: int, windows: int, rate: float) -> float:
        """Minus the decimal logarithm of the chance of so many among ordinary windows (its
        leading term); 0 if there are not more than expected."""
        expected = windows * rate
        if found <= expected:
            return 0.0
        return (expected - found * math.log(expected) + math.lgamma(found + 1)) / math.log(10)

    def found(self, counts: Counter) -> int:
        return sum(n for (length, saved), n in counts.items() if saved >= self.thresholds[length])

    def evidence(self, counts: Counter) -> float:
        return self.surprise(self.found(counts), counts.total(), self.rate)

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return self.prior
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, 2 * (self.evidence(self.counts(text)) - self.cut)))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pair", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.toxic:
            self.start()


def thresholds_at(share: float, ordinary: Counter) -> tuple[int, ...]:
    """By length: the least saving, LEAST or more, that at most that share reaches."""
    out = []
    for length in range(LENGTHS + 1):
        saved = sorted(((d, n) for (size, d), n in ordinary.items() if size == length), reverse=True)
        left, threshold = share * sum(n for _, n in saved), LEAST
        for d, n in saved:
            left -= n
            if left < 0:
                threshold = max(LEAST, d + 1)
                break
        out.append(threshold)
    return tuple(out)


def calibrate(evidence: tuple[list[float], list[float]]) -> tuple[float, float]:
    """The cut between ordinary and toxic values with the best share of toxic ones above,
    less ALARM times that of ordinary ones, and that best."""
    values = [np.sort(x) for x in evidence]
    steps = np.unique(np.concatenate(values))
    cuts = np.append((steps[:-1] + steps[1:]) / 2, steps[-1] + 1)
    above = [1 - np.searchsorted(x, cuts) / len(x) for x in values]
    gain = above[1] - ALARM * above[0]
    ties = np.flatnonzero(gain == gain.max())
    best = ties[len(ties) // 2]
    return float(cuts[best]), float(gain[best])


def fit(rows: list[tuple[int, str]]) -> Model:
    """A model of (label, text) rows: two thirds give the dictionaries, the rest the
    thresholds.  Without rows of both labels, or too few of them, it is the share of
    toxic ones alone."""
    by = {k: [t for label, t in rows if label == k] for k in (0, 1)}
    prior = len(by[1]) / max(1, len(rows))
    fold = {k: ([words_in(t) for i, t in enumerate(v) if i % 3], v[::3]) for k, v in by.items()}
    best, model = -math.inf, Model(prior=prior)
    for segment in SEGMENTS if by[0] and by[1] else ():
        ordinary = trained(fold[0][0], ORDINARY_BYTES, segment)
        for size in TOXIC_BYTES:
            toxic = trained(fold[1][0], size, segment)
            if not (ordinary and toxic):
                continue
            tried = Model(toxic, ordinary, prior=prior).start()
            seen = [[tried.counts(t) for t in fold[k][1]] for k in (0, 1)]
            total = sum(seen[0], Counter())
            for share in SHARES:
                tried.thresholds = thresholds_at(share, total)
                # as thresholds were set on these windows, another one in each length is allowed for
                tried.rate = (tried.found(total) + LENGTHS) / (total.total() + LENGTHS)
                cut, gain = calibrate(tuple([tried.evidence(c) for c in x] for x in seen))
                if gain > best:
                    best, model = gain, Model(toxic, ordinary, tried.thresholds, tried.rate, cut, prior)
    return model.start() if model.toxic else model


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` texts of at most LONGEST characters for each class,
    among labelled rows that are not held out.  Of several labels of one doc_id the
    majority counts, and a tie none; of several texts the one of the smallest hash."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("toxic"))
    chosen = F.broadcast(choose(known, "toxic", per_class))  # at most two times per_class ids
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(chosen, "doc_id")
    rows = rows.groupBy("toxic", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return fit([(r["toxic"], r["text"]) for r in rows.sort("toxic", "doc_id").toLocalIterator()])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document.  Null and empty texts have no window and score as
    ordinary; with no labels of both kinds, all score the share of toxic ones.  Repeated
    rows score alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches):
        model = shared.value
        for batch in rows_of(batches):
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(part, SCHEMA)
