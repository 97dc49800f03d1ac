"""Benchmark decontamination over a positional inverted index, DataFrame functions only.

The index holds the postings (term, document, position) of the rarest terms of every
test window and item.  A phrase is looked up from its rarest term on: postings, moved
back by the term's offset in the window, are starts that can be; the lists of the next
rarest terms are intersected with them; what is left is compared word by word.  A
proximity match needs the rarest terms of an item near each other, in any order."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import cut, let, packed, small, unpacked, with_key

WINDOW = 10
#: Lists that are intersected for a window, from the rarest on, before words are compared.
LISTS = 3
#: A proximity match: so many of an item's rarest terms (all, if it has fewer) within
#: so many words of the rarest one.
NEAR_TERMS, NEAR_SPAN = 4, 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    other = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(F.lower(text))


def terms_of(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def count_terms(text: Column) -> Column:
    pattern = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"  # the class of NOT_WORD's complement; twice as fast as its negation
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item, window``: each run of ``width`` words; a shorter item is one window,
    an item without words none."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.slice(w, i, width))
        return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<array<string>>"))

    item = F.col("item_id").cast("string").alias("item")
    return items.select(item, F.explode(let(terms_of(F.col("text")), of)).alias("window")).distinct()


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, n``: postings in the documents of each test term that occurs.  Counts
    are summed map-side, so the most frequent words cost no shuffle."""
    words = docs.select(F.explode(terms_of(F.col("text"))).alias("term"))
    return words.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of some terms: ``term, k1, k2, position``."""
    rows = with_key(docs.select("doc_id", "text"), "text")
    words = rows.select("k1", "k2", F.posexplode(terms_of(F.col("text"))).alias("position", "term"))
    return words.join(terms, "term", "left_semi").select("term", "k1", "k2", "position")


class Index:
    """Counts of all test terms and stored postings of the rarest ones of ``items``; with
    ``near``, of those that proximity needs too."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = WINDOW, near: bool = False) -> None:
        self.docs = docs
        windows = test_windows(items, width).withColumn("w", F.xxhash64("window"))
        self.windows = cut(windows, "windows")
        words = items.select(F.col("item_id").cast("string").alias("item"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
        counts = term_counts(docs, small(words.select("term").distinct(), "vocabulary"))
        self.counts = cut(counts, "counts")
        self.lists = cut(self.window_lists(), "lists")
        wanted = self.lists.select("term")
        if near:
            self.near = cut(self.item_lists(words), "near")
            wanted = wanted.unionAll(self.near.select("term"))
        self.postings = cut(postings(docs, small(wanted.distinct(), "terms")).sortWithinPartitions("term"), "postings")

    def window_lists(self) -> DataFrame:
        """``w, rank, term, offset``: the rarest terms of each window that can occur (all its
        terms do), the rarest first."""
        cells = self.windows.select("w", "window").dropDuplicates(["w", "window"]).select("w", "window", F.posexplode("window").alias("offset", "term")).join(self.counts, "term", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")))
        first = cells.groupBy("w", "window").agg(order.alias("t")).where(F.col("t")[0]["n"] > 0)
        return first.select("w", F.posexplode(F.slice("t", 1, LISTS)).alias("rank", "t")).select("w", "rank", "t.term", "t.offset").distinct()

    def item_lists(self, words: DataFrame) -> DataFrame:
        """``item, rank, term, wanted``: the rarest terms of each item whose terms all occur
        among those, and how many these are."""
        counted = words.join(self.counts, "term", "left")
        order = F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")))
        first = counted.groupBy("item").agg(F.slice(order, 1, NEAR_TERMS).alias("t")).where(F.col("t")[0]["n"] > 0)
        return first.select("item", F.size("t").alias("wanted"), F.posexplode("t").alias("rank", "t")).select("item", "wanted", "rank", "t.term")

    def starts(self, rank: int) -> DataFrame:
        """``k1, k2, w, start``: the postings of the windows' terms of one rank, moved back."""
        lists = small(self.lists.where(F.col("rank") == rank).select("term", "w", "offset"), "rank")
        moved = self.postings.join(lists, "term").withColumn("start", F.col("position") - F.col("offset"))
        return moved.where("start >= 0").select("k1", "k2", "w", "start")

    def phrases(self) -> DataFrame:
        """``k1, k2, item, start, stop``: occurrences of windows, as word positions."""
        found = self.starts(0)
        for rank in range(1, LISTS):
            # a window of so few words is whole already
            short = small(self.lists.groupBy("w").agg(F.max("rank").alias("last")).where(F.col("last") < rank).select("w"), "short")
            more = self.starts(rank).unionAll(found.join(short, "w", "left_semi").select("k1", "k2", "w", "start"))
            found = found.join(more, ["k1", "k2", "w", "start"], "left_semi")
        found = cut(found.distinct(), "found")
        holders = small(found.select("k1", "k2").distinct(), "holders")
        words = with_key(self.docs.select("doc_id", "text"), "text").join(holders, ["k1", "k2"], "left_semi").select("k1", "k2", terms_of(F.col("text")).alias("words")).dropDuplicates(["k1", "k2"])
        spots = found.join(small(self.windows, "windows"), "w").groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "window", "start")).alias("spots"))
        equal = lambda s: F.slice(F.col("words"), s["start"] + 1, F.size(s["window"])) == s["window"]
        kept = words.join(spots, ["k1", "k2"]).select("k1", "k2", F.explode(F.filter("spots", equal)).alias("s"))
        return kept.select("k1", "k2", "s.item", "s.start", (F.col("s.start") + F.size("s.window")).alias("stop")).distinct()

    def proximities(self) -> DataFrame:
        """``k1, k2, item``: documents where an item's rarest terms all stand within
        NEAR_SPAN words of the rarest one.  Postings meet in cells of that width."""
        cell = lambda p: F.floor(p / NEAR_SPAN)
        lists = small(self.near, "near")
        met = self.postings.join(lists, "term").select("k1", "k2", "item", "wanted", "rank", "position")
        first = met.where("rank = 0").select("k1", "k2", "item", "wanted", "position", F.explode(F.array(*[cell(F.col("position")) + i for i in (-1, 0, 1)])).alias("cell"))
        other = met.where("rank > 0").select("k1", "k2", "item", "rank", F.col("position").alias("q"), cell(F.col("position")).alias("cell"))
        near = first.join(other, ["k1", "k2", "item", "cell"]).where(F.abs(F.col("q") - F.col("position")) <= NEAR_SPAN)
        whole = near.groupBy("k1", "k2", "item", "position", "wanted").agg(F.count_distinct("rank").alias("n")).where("n = wanted - 1")
        alone = met.where("wanted = 1").select("k1", "k2", "item")
        return whole.select("k1", "k2", "item").unionAll(alone).distinct()


def covered(spans: Column) -> Column:
    """Positions inside the union of sorted (start, stop) pairs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["stop"]).alias("end"), (a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def exact_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``k1, k2, item, start, stop``: occurrences of item windows, as word positions."""
    return Index(docs, items, width).phrases()


def proximity_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``k1, k2, item``: documents with an item's rarest words near each other."""
    return Index(docs, items, near=True).proximities()


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, n_near``; the last counts the items with a proximity match.

    Null texts have no words; empty tables give no hits; repeated rows have equal
    results.  An item without an id has no name to be listed by: its words are hit, and
    it isn't counted.  Documents are joined to their few hits by (doc_id, hash of the text)."""
    index = Index(docs, items, width, near=True)
    phrases = (
        index.phrases()
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
        .select("k1", "k2", covered(F.col("spans")).alias("hit"), "items")
    )
    near = index.proximities().groupBy("k1", "k2").agg(F.count("item").alias("near"))
    hits = phrases.join(near, ["k1", "k2"], "full")
    rows = with_key(docs, "doc_id", "text").select("doc_id", "k1", "k2", count_terms(F.col("text")).alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hits, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; all columns as they are."""
    hits = small(exact_matches(docs, items, width).select("k1", "k2").distinct(), "hits")
    return unpacked(packed(docs).join(hits, ["k1", "k2"], "left_anti"))
