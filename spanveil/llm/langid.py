"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of order 0 to 3 with the counts of the
bytes that followed.  A byte costs -log2 of its share in the longest context that has
seen it, plus the escapes from longer ones (method C: a context with n bytes of q
kinds escapes with q / (n + q)); a byte that no context has seen costs another eight
bits.  The statistics are frozen after fitting: the costs of all strings of a context
and a byte that any language has seen, and the escapes of all contexts, are worked
out beforehand.  The language with the shortest code wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_of
from spanveil.llm.sampling import choose

ORDER = 3
#: The documented bound of the sample: rows for each language, and the longest text in it.
PER_LANGUAGE = 250
LONGEST = 20_000
CHUNK = 1 << 18
ASCII_LETTER = re.compile(r"[A-Za-z]")
NONE = "und"
#: What stands before the first byte of a text.
BEFORE = b" " * ORDER


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


def strings(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte of a text after BEFORE, with the ``order`` bytes before it, as a number."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint32)
    for back in range(order, -1, -1):
        out = out << np.uint32(8) | data[ORDER - back : ORDER - back + n]
    return out


def octets(text: str) -> np.ndarray:
    return np.frombuffer(BEFORE + text.encode("utf-8", "replace"), np.uint8)


class Table:
    """Numbers and what belongs to them, found by hash: a number stands in the slot of its
    hash, or in one of the next few."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, self.probes = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = self.slot(keys[left], self.probes)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.probes += 1

    def slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed + np.uint64(probe)).astype(np.int64) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 if it is not here."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            place = self.slots[self.slot(keys[left], probe)]
            hit = (place >= 0) & (self.keys[place] == keys[left])
            out[left[hit]] = place[hit]
            left = left[(place >= 0) & ~hit]
            if not len(left):
                break
        return out


@dataclass
class Model:
    languages: list[str]
    costs: list[Table]  # of each order: string -> bits for each language
    escapes: list[Table]  # of each order: context -> bits of leaving it

    def bits(self, text: str) -> tuple[np.ndarray, int]:
        """Code length of the whole text for each language, and its bytes."""
        data = octets(text)
        total, n = np.zeros(len(self.languages)), len(data) - ORDER
        for at in range(0, n, CHUNK):
            part = data[at : min(at + CHUNK, n) + ORDER]
            left = np.arange(len(part) - ORDER)
            for order in range(ORDER, -1, -1):
                key = strings(part, order)[left]
                costs, escapes = self.costs[order], self.escapes[order]
                place = costs.find(key)
                seen = place >= 0
                total += costs.values[place[seen]].sum(axis=0)
                left = left[~seen]
                if not len(left):
                    break
                context = escapes.find(key[~seen] >> np.uint32(8))
                total += escapes.values[context[context >= 0]].sum(axis=0)
            total += 8.0 * len(left)
        return total, n

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and bits a byte.  A null text or one without a letter has
        none.  The score is the posterior share on evidence of up to 64 bytes."""
        if not text or not self.languages or not has_letter(text):
            return NONE, 0.0, 0.0
        total, n = self.bits(text)
        rate = total / n
        share = np.exp2(-(rate - rate.min()) * min(n, 64))
        best = int(np.argmin(total))
        return self.languages[best], float(share[best] / share.sum()), float(rate[best])


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows."""
    languages = sorted({x for x, _ in rows})
    costs: list[Table] = []
    escapes: list[Table] = []
    for order in range(ORDER + 1):
        counted = [np.unique(np.concatenate([strings(octets(t), order) for y, t in rows if y == x]), return_counts=True) for x in languages]
        keys = np.unique(np.concatenate([k for k, _ in counted] or [np.zeros(0, np.uint32)]))
        contexts, owner = np.unique(keys >> np.uint32(8), return_inverse=True)
        count = np.zeros((len(keys), len(languages)))
        for j, (k, n) in enumerate(counted):
            count[np.searchsorted(keys, k), j] = n
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, owner, count)
        np.add.at(kinds, owner, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(count / (total + kinds)[owner])
        if order:
            # every shorter string of a seen one was seen too
            shorter = costs[-1].values[costs[-1].find(keys & np.uint32((1 << 8 * order) - 1))]
        else:
            shorter = np.full((len(keys), len(languages)), 8.0)
        costs.append(Table(keys, np.where(count > 0, own, leave[owner] + shorter)))
        escapes.append(Table(contexts, leave))
    return Model(languages, costs, escapes)


def held_out():
    """Rows that learning must not see."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` texts of at most LONGEST characters for each
    language, among rows that are not held out and have a language."""
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out())
    rows = choose(labelled, "lang", per_language).where(F.length("text").between(1, LONGEST))
    return fit([(r["lang"], r["text"]) for r in rows.sort("lang", "doc_id").collect()])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: the columns of SCHEMA, and those in ``keep`` as
    ``keep_0, keep_1, ..``.  The prediction sees the text alone.  Null and empty texts and
    those without a letter are ``und`` with score 0, and so are all if no row has a
    language.  Nothing is shuffled; the model, whose size is bounded by the sample, is
    broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or train(docs))
    names = ["doc_id", "text", "held_out", *keep]
    rows = docs.select("doc_id", "text", held_out().alias("held_out"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])

    def part(batches):
        model = shared.value
        for batch in rows_of(batches):
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
                + [batch.column(i) for i in range(3, len(names))],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"] + [f"keep_{i}" for i in range(len(keep))],
            )

    types = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return rows.mapInArrow(part, SCHEMA + types)
