"""Organisation, address and person detectors: token walks that columns can't express, as
Arrow UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spanveil.config import SPAN, Config
from spanveil.functions import lexicons as L
from spanveil.functions import people, walks
from spanveil.functions.text import norm
from spanveil.operators.detectors import any_of, register, whole_cell


def _arrow(find, kind: str, name: str):
    """The walk as an Arrow UDF; its closure names session-free modules only."""
    make = walks.spans_of

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield make(texts, find, kind, name)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, f"array<{SPAN}>")


def _only_where(pattern: str, udf) -> Column:
    """Texts without the anchor go to the UDF as null: they cross to Python as nothing."""
    return F.coalesce(udf(F.when(F.col("text").rlike(pattern), F.col("text"))), F.array().cast(f"array<{SPAN}>"))


@register("organization.suffix", "ORGANIZATION")
def organization(config: Config) -> Column:
    return _only_where(rf"(?U)(?<!\w)(?:{any_of({x for s in L.ORG_SUFFIXES for x in (s, s.upper())})})(?!\w)", _arrow(walks.organizations, "ORGANIZATION", "organization.suffix"))


@register("address.anchored", "ADDRESS")
def address(config: Config) -> Column:
    cell = norm(F.col("column_header")).isin(list(L.ADDRESS_HEADERS)) & (F.length(F.trim(F.col("text"))) >= walks.FLOOR) & F.lower(F.col("text")).rlike(r"\b(?:" + "|".join((*L.ADDRESS_WORDS, *L.LOCALITIES)) + r")\b")
    return F.concat(_only_where(r"\d{3} ?\d{3}|[A-Z]{2} \d{5}", _arrow(walks.addresses, "ADDRESS", "address.anchored")), whole_cell(F.coalesce(cell, F.lit(False)), "ADDRESS", "address.anchored"))


@register("person.hybrid", "PERSON")
def person(config: Config) -> Column:
    header = F.coalesce(norm(F.col("column_header")).isin(list(L.NAME_HEADERS)), F.lit(False))
    cells = F.when(header & (F.length(F.trim("text")) <= 80), F.col("text"))
    named = F.coalesce(_arrow(people.listed, "PERSON", "person.hybrid")(cells), F.array().cast(f"array<{SPAN}>"))
    return F.concat(named, _only_where(rf"(?i)\b(?:{any_of(people.CUE_WORDS)})\b", _arrow(people.people, "PERSON", "person.hybrid")))
