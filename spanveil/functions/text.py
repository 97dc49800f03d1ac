"""Column functions over text: normal form, matches with offsets, checksums, case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BEGIN, END = "\x01", "\x02"
MATCHES = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for many uses in higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(text: Column) -> Column:
    """The key of entity equality: quotes, dashes and blanks folded, single blanks, lower case."""
    folded = F.translate(text, "‘’“”–—− ", "''\"\"--- ")
    return F.lower(F.trim(F.regexp_replace(folded, r"(?U)\s+", " ")))


def matches(text: Column, pattern: str | Column, group: int | None = None, groups: int = 1, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as (start, end, text), in code points.

    Sentinels are put around each match, or around one of ``groups`` consecutive
    groups that make up the pattern, and the text is split at them: odd pieces are the
    matches, and the lengths before a piece add up to its start.  Stays in the JVM.
    ``guard`` is a cheap condition that every text with a match fulfils."""
    clean = F.when(text.contains(BEGIN) | text.contains(END), F.translate(text, BEGIN + END, "  ")).otherwise(text)
    if isinstance(pattern, str):
        wrapped = F.lit(pattern if group else f"({pattern})")
    else:
        wrapped = F.concat(F.lit("("), pattern, F.lit(")"))
    put = "".join(f"{BEGIN}${i}{END}" if i == (group or 1) else f"${i}" for i in range(1, (groups if group else 1) + 1))
    pieces = F.split(F.regexp_replace(clean, wrapped, F.lit(put)), f"[{BEGIN}{END}]")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(MATCHES).alias("out"))

    def step(a: Column, x: Column) -> Column:
        here = F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("text"))
        return F.struct((a["at"] + F.length(x)).alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(pieces, zero, step, lambda a: a["out"])
    possible = text.isNotNull() if guard is None else text.isNotNull() & guard
    return F.when(possible & F.regexp_like(clean, wrapped), found).otherwise(F.array().cast(MATCHES))


def before(text: Column, start: Column, width: int) -> Column:
    """Up to ``width`` characters before a position."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, start - first)


def after(text: Column, end: Column, width: int) -> Column:
    return F.substring(text, end + 1, F.lit(width))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def distinct_digits(text: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(digits(text), ""), lambda x: x != "")))


def dihedral(a: int, b: int) -> int:
    """The group of the pentagon's ten symmetries: 0 to 4 are rotations, 5 to 9 reflections."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


DIHEDRAL = [[dihedral(a, b) for b in range(10)] for a in range(10)]
#: Verhoeff's permutation, of which the others are powers.
PERMUTE = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
while len(PERMUTE) < 8:
    PERMUTE.append([PERMUTE[1][x] for x in PERMUTE[-1]])


def verhoeff(text: Column) -> Column:
    """The checksum over a text of digits; 0 if it is valid."""
    table = F.lit("".join(str(x) for row in DIHEDRAL for x in row))
    turn = F.lit("".join(str(x) for row in PERMUTE for x in row))
    at = lambda s, i: F.substring(s, i + 1, F.lit(1)).cast("int")
    cells = F.transform(F.split(F.reverse(text), ""), lambda c, i: at(turn, (i % 8) * 10 + c.cast("int")))
    return F.aggregate(cells, F.lit(0), lambda a, x: at(table, a * 10 + x))


def case_style(text: Column) -> Column:
    letters = F.regexp_replace(text, r"(?U)[^\p{L}]", "")
    return F.when(letters == "", "none").when(letters == F.upper(letters), "upper").when(letters == F.lower(letters), "lower").when(F.initcap(F.lower(text)) == text, "title").otherwise("mixed")


def match_case(text: Column, like: Column) -> Column:
    style = case_style(like)
    return F.when(style == "upper", F.upper(text)).when(style == "lower", F.lower(text)).otherwise(text)


def host_of(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.regexp_replace(url, " ", "")), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[/?#].*$", ""), r"^www\.", "")


def chance(seed: int, *parts: Column) -> Column:
    """A non-negative whole number from a hash of the seed and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def pick(pool: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (number % len(pool) + 1).cast("int"))
