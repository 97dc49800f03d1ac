"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACE, let, words_of

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the corpus' languages (English, French, German, Spanish).
STOP_WORDS = ("the", "of", "and", "in", "is", "le", "la", "de", "et", "les", "der", "die", "und", "das", "zu", "el", "en", "que", "los", "y")

#: rule, feature, lowest and highest value that pass (None: no bound).
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, None),
    ("repeated words", "repeat_ratio", None, 0.5),
    ("mean word length", "mean_word", 2.0, 20.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop words", "stop_ratio", 0.01, None),
    ("repeated lines", "dup_line_ratio", None, 0.5),
)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a chained 64-bit hash.  A set of the hashes tells at
    once that nothing repeats; otherwise (hash, position) pairs are sorted, equal
    neighbours give the repeated positions, and each adds the words up to three
    that the one before it doesn't cover: n log n for a text of any length."""

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, x, j: (F.get(s, j)["h"] == x["h"]) & (j >= 0)
        again = lambda s: F.filter(s, lambda x, i: F.coalesce(same(s, x, i - 1), F.lit(False)) | F.coalesce(same(s, x, i + 1), F.lit(False)))
        return F.sort_array(F.transform(let(pairs, again), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(3), x - F.when(i > 0, F.get(p, i - 1)).otherwise(x - 3)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(positions(h), covered))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, 0).otherwise(let(hashes, of_hashes))

    return let(words, of_words).cast("long")


def features(text: Column) -> Column:
    """A struct of counts.  A null or empty text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        ),
    )


def verdicts(thresholds=THRESHOLDS) -> list[Column]:
    """One boolean column for each row of the table: the rule passes."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratio = {
        "n_words": F.col("n_words"),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_ratio": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }
    out = []
    for rule, feature, low, high in thresholds:
        bounds = [ratio[feature] >= low] * (low is not None) + [ratio[feature] <= high] * (high is not None)
        out.append(reduce(lambda a, b: a & b, bounds, F.lit(True)).alias(f"pass_{rule.replace(' ', '_')}"))
    return out


def score(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row for each document: counts, ``base_failed`` (under 50 words, or over
    half of the words in repeated windows) and ``kept`` (not base_failed and
    every rule of the table passes).  No shuffle, no user function."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = docs.select("doc_id", features(F.col("text")).alias("f")).select("doc_id", "f.*")
    kept = reduce(lambda a, b: a & b, verdicts(thresholds), ~base)
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"), "n_lines", "n_stop")
