"""The entity dictionary of pass 1, and the sweep of pass 2 for its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.config import SWEPT, Config
from spanveil.functions import lexicons as L
from spanveil.functions.text import let, matches, norm
from spanveil.operators.detectors import any_of, looks_like_person, name_hint
from spanveil.sources.store import keep

DERIVED, OBSERVED = 0.72, 0.95
ALIAS = r"(?U)((?:\p{Lu}[\p{L}\d&.'’\-]*\s+(?:(?:and|&)\s+)?){1,8}(?:" + any_of(L.ORG_SUFFIXES) + r"))\s*\((?:the\s+)?[\"“]([^\"”)]{2,60})[\"”]\)"


def short_forms(name: Column) -> Column:
    """First and last name, and a surname of four letters or more; initials are left out."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: ~w.rlike(r"^\p{Lu}\.?$") & (w != ""))
    last = F.element_at(words, -1)
    telling = ~F.lower(last).isin([*L.GENERIC_WORDS, *L.NON_PERSON_TOKENS, *L.ADDRESS_WORDS])
    out = F.array(F.when(F.size(words) >= 3, F.concat_ws(" ", F.element_at(words, 1), last)), F.when((F.size(words) >= 2) & (F.length(last) >= 4) & telling, last))
    return F.when(F.size(words) > 0, F.filter(out, lambda x: x.isNotNull() & looks_like_person(x, single=True))).otherwise(F.array().cast("array<string>"))


def brand_forms(name: Column) -> Column:
    """The name without its suffix, and a leading acronym."""
    stem = F.trim(F.regexp_replace(name, rf"(?U)(?:\s+(?:{any_of(L.ORG_SUFFIXES)}))+$", ""))
    acronym = F.regexp_extract(name, r"^([A-Z]{2,5})\b", 1)
    public = [*L.PUBLIC_TOKENS]
    parts = F.array(
        F.when((F.size(F.split(stem, " ")) >= 2) & (F.length(stem) >= 6) & (stem != name) & ~F.lower(stem).isin([*L.ROLE_PHRASES, *L.PUBLIC_BODIES]), stem),
        F.when((acronym != "") & ~F.lower(acronym).isin(public) & ~F.lower(acronym).isin(list(L.GENERIC_WORDS)), acronym),
    )
    return F.filter(parts, lambda x: x.isNotNull())


def scope_of(config: Config) -> Column:
    return F.col("doc_id").cast("string") if config.scope == "doc_id" else F.lit("corpus")


def defined_aliases(segments: DataFrame, config: Config) -> DataFrame:
    """``Name ("Alias")``: the alias under its name."""
    hit = F.regexp_extract_all(F.col("text"), F.lit(ALIAS), F.lit(0))
    one = segments.where(F.col("text").rlike(ALIAS)).select(scope_of(config).alias("scope"), F.explode(hit).alias("m"))
    return one.select("scope", F.regexp_extract("m", ALIAS, 2).alias("surface"), F.lit("ORGANIZATION").alias("pii_type"), F.lit("organization.alias").alias("source"), F.regexp_extract("m", ALIAS, 1).alias("parent"))


def observed(spans: DataFrame, config: Config) -> DataFrame:
    """Surfaces of swept kinds, with the persons that mail addresses hint at."""
    seen = spans.where(F.col("pii_type").isin(list(SWEPT))).select(scope_of(config).alias("scope"), F.col("text").alias("surface"), "pii_type", F.col("detector").alias("source"), F.lit(None).cast("string").alias("parent"))
    mail = spans.where(F.col("pii_type") == "EMAIL").select(scope_of(config).alias("scope"), name_hint(F.substring_index("text", "@", 1)).alias("surface"), F.lit("PERSON").alias("pii_type"), F.lit("email.hint").alias("source"), F.lit(None).cast("string").alias("parent"))
    return seen.unionByName(mail.where("surface is not null"))


def build(spans: DataFrame, segments: DataFrame, config: Config) -> DataFrame:
    """``scope, key, surface, pii_type, parent_key, derived``: one row for each normalised
    surface, the longest spelling first; parts of names hang on the whole name.

    Everything is an aggregate over a total order, so the dictionary doesn't depend on
    the order in which tasks end."""
    base = observed(spans, config).unionByName(defined_aliases(segments, config))
    parts = base.where("parent is null").select(
        "scope",
        F.explode(F.when(F.col("pii_type") == "PERSON", short_forms(F.col("surface"))).when(F.col("pii_type") == "ORGANIZATION", brand_forms(F.col("surface"))).otherwise(F.array().cast("array<string>"))).alias("surface"),
        "pii_type",
        F.concat("source", F.lit(":derived")).alias("source"),
        F.col("surface").alias("parent"),
    )
    every = base.unionByName(parts).withColumn("key", norm(F.col("surface"))).withColumn("parent_key", norm(F.col("parent")))
    return every.groupBy("scope", "key").agg(
        F.max_by("surface", F.struct(F.length("surface"), "surface")).alias("surface"),
        F.min_by("pii_type", F.struct(F.col("source").endswith(":derived"), F.col("pii_type"))).alias("pii_type"),
        F.max_by("parent_key", F.struct(F.length("parent_key"), "parent_key")).alias("parent_key"),
        F.min(F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("dependent"),
        F.bool_and(F.col("source").endswith(":derived")).alias("derived"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    ).select("scope", "key", "surface", "pii_type", F.when((F.col("dependent") == 1) & (F.col("parent_key") != F.col("key")), F.col("parent_key")).alias("parent_key"), "derived", "sources")


def canonical(gazetteer: DataFrame) -> DataFrame:
    """Adds ``canonical_key``: the end of each alias chain, however long.  A parent that is no
    entry ends its chain; names that lead into a circle stand for themselves.

    Every round doubles the length of the chains that are followed."""
    end = gazetteer.select("scope", "key", F.coalesce("parent_key", "key").alias("canonical_key"))
    n = gazetteer.where("parent_key is not null").count()
    for _ in range(n.bit_length()):
        far = end.select(F.col("scope").alias("s"), F.col("key").alias("k"), F.col("canonical_key").alias("next"))
        step = end.join(far, (F.col("scope") == F.col("s")) & (F.col("canonical_key") == F.col("k")), "left")
        step = keep(step.select("scope", "key", F.coalesce("next", "canonical_key").alias("canonical_key"), (F.col("next") != F.col("canonical_key")).alias("moved")), "chains")
        end = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    on = gazetteer.where("parent_key is not null").select(F.col("scope").alias("s"), F.col("key").alias("k"))
    out = end.join(on, (F.col("scope") == F.col("s")) & (F.col("canonical_key") == F.col("k")), "left")
    out = out.select("scope", "key", F.when(F.col("k").isNull(), F.col("canonical_key")).otherwise(F.col("key")).alias("canonical_key"))
    return gazetteer.join(out, ["scope", "key"])


def case_sensitive(surface: Column) -> Column:
    return (F.length(surface) <= 6) & surface.rlike(r"^\p{Lu}+$")


def entries_of(gazetteer: DataFrame) -> DataFrame:
    """What is looked for: entries of swept kinds, three characters long or more."""
    return gazetteer.where(F.col("pii_type").isin(list(SWEPT)) & (F.length("surface") >= 3))


def alternations(entries: DataFrame) -> DataFrame:
    """``scope, pii_type, pattern``: the entries of one scope and kind as one pattern, longest
    first, blanks of any width, no word or mail character beside; entries in capitals
    by their case only."""
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace("surface", r"(?U)\s+", r"\\E\\s+\\Q"), F.lit("\\E"))
    lead = F.when(F.col("surface").rlike(r"(?U)^\w"), r"(?<![\w@.])").otherwise("")
    tail = F.when(F.col("surface").rlike(r"(?U)\w$"), r"(?![\w@])").otherwise("")
    one = F.when(case_sensitive(F.col("surface")), F.concat(F.lit("(?-i:"), quoted, F.lit(")"))).otherwise(quoted)
    forms = entries.select("scope", "pii_type", F.struct((-F.length("surface")).alias("n"), F.lower("surface").alias("s"), F.concat(lead, one, tail).alias("p")).alias("form"))
    grouped = forms.groupBy("scope", "pii_type").agg(F.transform(F.array_sort(F.collect_set("form")), lambda x: x["p"]).alias("forms"))
    return grouped.select("scope", "pii_type", F.concat(F.lit("(?Uiu)(?:"), F.array_join("forms", "|"), F.lit(")")).alias("pattern"))


HIT = "array<struct<start:int,stop:int,text:string>>"


def swept(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """``scope, doc_id, key, pii_type, start, end, text`` -> spans: the leftmost, and of these the
    longest, hits of each segment and kind that do not overlap."""
    rows = F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("stop"), "text")))
    end = lambda a: F.coalesce(-F.get(a, F.size(a) - 1)["stop"], F.lit(0))
    pick = lambda a, x: F.when(x["start"] >= end(a), F.concat(a, F.array(x))).otherwise(a)
    kept = hits.groupBy("scope", "doc_id", "key", "pii_type").agg(F.aggregate(rows.cast(HIT), F.array().cast(HIT), pick).alias("r"))
    kept = kept.select("scope", "doc_id", "key", "pii_type", F.explode("r").alias("h")).withColumn("norm", norm(F.col("h.text")))
    known = entries.select(F.col("scope").alias("s"), F.col("key").alias("k"), "derived")
    out = kept.join(known, (F.col("scope") == F.col("s")) & (F.col("norm") == F.col("k")))
    return out.select(
        "doc_id", "key", F.col("h.start").alias("start"), (-F.col("h.stop")).alias("end"), F.col("h.text").alias("text"), "pii_type",
        F.lit("gazetteer.sweep").alias("detector"), F.when(F.col("derived"), DERIVED).otherwise(OBSERVED).alias("confidence"),
    )


def sweep(segments: DataFrame, gazetteer: DataFrame, config: Config) -> DataFrame:
    """Pass 2 for document scope: segments meet the patterns of their document only."""
    entries = entries_of(gazetteer)
    met = segments.select(scope_of(config).alias("scope"), "doc_id", "key", "text").join(alternations(entries), "scope")
    hits = met.select("scope", "doc_id", "key", "pii_type", F.explode(matches(F.col("text"), F.col("pattern"))).alias("m"))
    return swept(hits.select("scope", "doc_id", "key", "pii_type", "m.*"), entries)


WORDS = r"(?U)\w+"


def sweep_ngrams(segments: DataFrame, gazetteer: DataFrame, config: Config) -> DataFrame:
    """Pass 2 for large dictionaries: the words of the segments meet the first words of the
    entries in an equi-join, and the run of words that an entry is long is compared with
    it in its normal form.  Cost follows the text and the entries that begin with its
    words, not the number of entries; entries may have any length."""
    entries = entries_of(gazetteer)
    words = F.regexp_extract_all("key", F.lit(WORDS), F.lit(0))
    heads = entries.select(
        F.col("scope"), F.col("key").alias("entry"), "surface", "pii_type", F.get(words, F.lit(0)).alias("first"), F.size(words).alias("n"),
        F.length(F.regexp_extract("key", r"(?U)^\W*", 0)).alias("lead"), F.length(F.regexp_extract("key", r"(?U)\W*$", 0)).alias("tail"),
    ).where("n > 0")
    texts = segments.where("text is not null").select(scope_of(config).alias("scope"), "doc_id", "key", "text")
    spots = texts.select("scope", "doc_id", "key", F.posexplode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("i", "word"))
    met = spots.withColumn("first", F.lower("word")).join(heads, ["scope", "first"])
    asked = met.groupBy("scope", "doc_id", "key").agg(F.collect_list(F.struct("i", "n", "lead", "tail", "entry", "surface", "pii_type")).alias("asked"))

    def found(w: Column) -> Column:
        text = F.col("text")

        def one(a: Column) -> Column:
            start = F.get(w, a["i"])["start"] - a["lead"]
            end = F.get(w, a["i"] + a["n"] - 1)["end"] + a["tail"]
            return F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text"), a["entry"].alias("entry"), a["surface"].alias("surface"), a["pii_type"].alias("pii_type"))

        def fine(h: Column) -> Column:
            left = ~h["surface"].rlike(r"(?U)^\w") | ~F.substring(text, h["start"], F.lit(1)).rlike(r"(?U)[\w@.]") | (h["start"] == 0)
            right = ~h["surface"].rlike(r"(?U)\w$") | ~F.substring(text, h["end"] + 1, F.lit(1)).rlike(r"(?U)[\w@]")
            cased = ~case_sensitive(h["surface"]) | (h["text"] == h["surface"])
            return F.coalesce((h["start"] >= 0) & (norm(h["text"]) == h["entry"]) & left & right & cased, F.lit(False))

        return F.filter(F.transform("asked", one), fine)

    hits = texts.join(asked, ["scope", "doc_id", "key"]).select("scope", "doc_id", "key", F.explode(let(matches(F.col("text"), WORDS), found)).alias("h"))
    return swept(hits.select("scope", "doc_id", "key", "h.pii_type", "h.start", "h.end", "h.text"), entries)
