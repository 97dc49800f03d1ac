"""Consistent, format-preserving surrogates: one for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.config import Config
from spanveil.functions import lexicons as L
from spanveil.functions.text import case_style, chance, digits, host_of, let, match_case, norm, pick, verhoeff
from spanveil.operators.detectors import any_of


def substitute(text: Column, seed: int, key: Column) -> Column:
    """Every digit and letter by another of its class; all else stays where it is."""
    def one(c: Column, i: Column) -> Column:
        n = chance(seed, key, i)
        return F.when(c.rlike(r"\d"), (n % 10).cast("string")).when(c.rlike("[A-Z]"), F.char(n % 26 + 65)).when(c.rlike("[a-z]"), F.char(n % 26 + 97)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def refill(text: Column, source: Column) -> Column:
    """The digits of ``text`` by those of ``source`` in order, 0 when it has no more."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike(r"\d"), F.struct(F.concat(a["out"], F.rpad(F.substring(source, a["i"], F.lit(1)), 1, "0")).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), zero, step, lambda a: a["out"])


def digit_run(seed: int, key: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (chance(seed, key, i) % 10).cast("string")), "")


def luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the Luhn check."""
    total = F.aggregate(F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def card(text: Column, seed: int, key: Column) -> Column:
    d = digits(text)
    body = F.concat(F.substring(d, 1, 2), F.substring(digit_run(seed, key, F.length(d)), F.lit(1), F.length(d) - 3))
    return let(body, lambda b: refill(text, F.concat(b, luhn_digit(b))))


def ssn(text: Column, seed: int, key: Column) -> Column:
    area, group, serial = (chance(seed, key, F.lit(i)) for i in "abc")
    return refill(text, F.concat(F.lpad((area % 566 + 100).cast("string"), 3, "0"), F.lpad((group % 99 + 1).cast("string"), 2, "0"), F.lpad((serial % 9999 + 1).cast("string"), 4, "0")))


def phone(text: Column, seed: int, key: Column) -> Column:
    """The country code, separators and length stay; the subscriber number begins with 2 to 9."""
    lead = F.regexp_extract(text, r"^(\+\d{1,3})(?=\D)|^(\+\d\d)", 0)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    return F.concat(lead, refill(rest, F.concat((chance(seed, key) % 8 + 2).cast("string"), digit_run(seed, key, F.length(rest)))))


def ip(text: Column, seed: int, key: Column) -> Column:
    """Addresses of the documentation blocks."""
    n = chance(seed, key)
    v4 = F.concat(pick(("192.0.2.", "198.51.100.", "203.0.113."), n), (chance(seed, key, F.lit("h")) % 254 + 1).cast("string"))
    return F.when(text.contains(":"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(n % 65536)))).otherwise(v4)


def dob(text: Column, seed: int, key: Column) -> Column:
    day = F.date_add(F.lit("1950-01-01").cast("date"), (chance(seed, key) % 18262).cast("int"))
    return (
        F.when(text.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd"))
        .when(text.rlike(r"^\d+/"), F.date_format(day, "dd/MM/yyyy"))
        .when(text.rlike(r"^\d+-"), F.date_format(day, "dd-MM-yyyy"))
        .when(text.rlike(r"^\d+\."), F.date_format(day, "dd.MM.yyyy"))
        .when(text.rlike(r"^\d+"), F.date_format(day, "d MMMM yyyy"))
        .when(text.rlike(r"\d.*\d{4}$") & text.rlike(r"\s\d{1,2}\D"), F.date_format(day, "MMMM d, yyyy"))
        .otherwise(F.date_format(day, "MMMM yyyy"))
    )


#: Codes of states and of company classes inside a company number (CIN).
CIN = r"^([UuLl])\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}$"
CIN_STATES = ("MH", "DL", "KA", "TN", "GJ", "WB", "TG", "RJ", "UP", "HR", "KL", "PN")
CIN_CLASSES = ("PTC", "PLC", "NPL", "GOI", "FTC")


def cin(text: Column, seed: int, key: Column) -> Column:
    """Listing letter, industry, state, year, class and number, each of its own kind."""
    part = lambda name, n: F.lpad((chance(seed, key, F.lit(name)) % 10**n).cast("string"), n, "0")
    year = (chance(seed, key, F.lit("year")) % 70 + 1950).cast("string")
    return F.concat(F.substring(text, 1, 1), part("industry", 5), pick(CIN_STATES, chance(seed, key, F.lit("state"))), year, pick(CIN_CLASSES, chance(seed, key, F.lit("class"))), part("number", 6))


def national_id(text: Column, seed: int, key: Column) -> Column:
    d = digits(text)
    body = F.concat((chance(seed, key) % 8 + 2).cast("string"), F.substring(digit_run(seed, key, F.lit(12)), 1, 10))
    inverse = F.element_at(F.array(*[F.lit(x) for x in "0432156789"]), verhoeff(F.concat(body, F.lit("0"))) + 1)
    return F.when(text.rlike(r"^[\d -]+$") & (F.length(d) == 12), refill(text, F.concat(body, inverse))).when(text.rlike(CIN), cin(text, seed, key)).otherwise(substitute(text, seed, key))


def person(text: Column, rank: Column) -> Column:
    """As many words; initials stay initials.  Ranks run through all pairs of the pools, so
    different people get different names; beyond that a number follows."""
    nf, nl = len(L.FIRST_NAMES), len(L.LAST_NAMES)
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")
    name = lambda w, i: F.when(w.rlike(r"^\p{Lu}\.?$"), w).when((i == 0) & (F.size(words) > 1), pick(L.FIRST_NAMES, F.floor(rank / nl))).otherwise(pick(L.LAST_NAMES, rank + i * 7))
    more = F.when(rank >= nf * nl, F.concat(F.lit(" "), (F.floor(rank / (nf * nl)) + 1).cast("string"))).otherwise("")
    return F.concat(F.array_join(F.transform(words, name), " "), more)


def organization(text: Column, rank: Column) -> Column:
    """As many words, the first one telling; connectives and the legal form stay.  Ranks run
    through all pairs of the pools, beyond which a number follows."""
    suffix = F.regexp_extract(text, rf"(?U)(?:\s+(?:{any_of(L.ORG_SUFFIXES)}))+$", 0)
    stem = F.filter(F.split(F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(suffix))), r"(?U)\s+"), lambda w: w != "")
    heads, mids = len(L.ORG_HEADS), len(L.ORG_MIDS)
    word = lambda w, i: F.when(i == 0, pick(L.ORG_HEADS, rank)).when(F.lower(w).isin("and", "&", "of"), w).otherwise(pick(L.ORG_MIDS, F.floor(rank / heads) + (i - 1) * 5))
    pairs = F.when(F.size(stem) > 1, heads * mids).otherwise(heads)
    more = F.when(rank >= pairs, F.concat(F.lit(" "), (F.floor(rank / pairs) + 1).cast("string"))).otherwise("")
    return F.concat(F.array_join(F.transform(stem, word), " "), more, suffix)


def address(text: Column, seed: int, key: Column, rank: Column) -> Column:
    """As many elements between commas; a code, its dash and its blank, a state and a country
    stay what they are."""
    low = F.lower(text)
    code = F.regexp_extract(text, r"\d{3} ?\d{3}(?!\d)|\d{5}", 0)
    state = F.regexp_extract(text, rf"(?i)\b(?:{any_of(L.STATES)})\b", 0)
    country = F.regexp_extract(text, r"(?i)\b(?:india|usa|singapore|united kingdom)\b", 0)
    dash = F.when(text.contains("–"), " – ").otherwise(" - ")
    town = pick(L.PLACES, chance(seed, key, F.lit("p")))
    coded = F.when(code != "", F.concat(town, dash, refill(code, F.concat((chance(seed, key, F.lit("z")) % 8 + 1).cast("string"), digit_run(seed, key, F.lit(6)))))).otherwise(town)
    left = F.size(F.split(low, ",")) - 1 - F.when(state != "", 1).otherwise(0) - F.when(country != "", 1).otherwise(0)
    kinds = ("House", "Road", "Park", "Lane", "Court")
    name = lambda i: F.when(i == 1, (rank + 1).cast("string")).otherwise(F.concat(pick(L.STREETS, chance(seed, key, i)), F.lit(" "), pick(kinds, i - 2)))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(left, F.lit(2))), name)
    tail = F.filter(F.array(coded, state, country), lambda x: x != "")
    return F.array_join(F.concat(parts, tail), ", ")


def email(seed: int, key: Column, rank: Column) -> Column:
    local = F.concat_ws(".", F.lower(pick(L.FIRST_NAMES, rank)), F.lower(pick(L.LAST_NAMES, F.floor(rank / len(L.FIRST_NAMES)))))
    return F.concat(local, F.when(rank >= len(L.FIRST_NAMES) * len(L.LAST_NAMES), rank.cast("string")).otherwise(""), F.lit("@example.com"))


def url(text: Column, seed: int, key: Column, rank: Column) -> Column:
    lead = F.regexp_extract(text, r"(?i)^(?:[a-z]+://)?(?:www\.)?", 0)
    path = F.regexp_extract(text, r"(?i)^(?:[a-z]+://)?[^/?#]*([/?#].*)$", 1)
    return F.concat(lead, F.lower(pick(L.ORG_HEADS, rank)), F.when(rank >= len(L.ORG_HEADS), rank.cast("string")).otherwise(""), F.lit(".example"), path)


#: Ranks of a corpus are counted in so many parts of the hash range.
PARTS = 256


def ranked(entities: DataFrame, order: Column, config: Config) -> DataFrame:
    """``entities`` with ``rank`` from 0 on within (scope, kind), by hash.  In corpus scope a
    kind's entities are ranked in parts of the hash range, and a part's ranks follow
    those of the parts before it."""
    if config.scope == "doc_id":
        return entities.withColumn("rank", (F.row_number().over(Window.partitionBy("scope", "pii_type").orderBy(order, "canonical_key")) - 1).cast("long"))
    part = F.floor(order / F.lit((1 << 48) / PARTS)).cast("int")
    parts = entities.withColumn("part", part)
    before = Window.partitionBy("scope", "pii_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("scope", "pii_type", "part").agg(F.count("*").alias("n"))  # PARTS rows a kind at most
    counts = counts.select("scope", "pii_type", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = parts.withColumn("place", F.row_number().over(Window.partitionBy("scope", "pii_type", "part").orderBy(order, "canonical_key")) - 1)
    return own.join(counts, ["scope", "pii_type", "part"]).withColumn("rank", (F.col("place") + F.col("offset")).cast("long")).drop("part", "place", "offset")


def entity_surrogates(entities: DataFrame, config: Config) -> DataFrame:
    """``scope, pii_type, canonical_key, canonical_text`` -> with ``surrogate``.

    Uniqueness comes from a rank within (scope, kind) by hash, run through the pools as
    a bijection: no shared state, no order of tasks."""
    s, text, key, rank = config.seed, F.col("canonical_text"), F.concat_ws("|", "pii_type", "canonical_key"), F.col("rank")
    kind = F.col("pii_type")
    rows = ranked(entities, chance(s, key), config)
    made = (
        F.when(kind == "PERSON", person(text, rank)).when(kind == "ORGANIZATION", organization(text, rank)).when(kind == "ADDRESS", address(text, s, key, rank))
        .when(kind == "EMAIL", email(s, key, rank)).when(kind == "URL", url(text, s, key, rank)).when(kind == "PHONE", phone(text, s, key))
        .when(kind == "SSN", ssn(text, s, key)).when(kind == "CREDIT_CARD", card(text, s, key)).when(kind == "DOB", dob(text, s, key))
        .when(kind == "IP_ADDRESS", ip(text, s, key)).otherwise(national_id(text, s, key))
    )
    return rows.withColumn("surrogate", F.when(norm(made) == norm(text), F.concat(made, F.lit(" II"))).otherwise(made)).drop("rank")


def squash(text: Column) -> Column:
    """Letters and digits of a name without its legal suffix."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, rf"(?U)(?:\s+(?:{any_of(L.ORG_SUFFIXES)}))+$", "")), "[^a-z0-9]", "")


def role_mailbox(local: Column) -> Column:
    """Whether a local part names an office, not a person."""
    return F.exists(F.split(F.lower(local), r"[._\-+]"), lambda x: x.isin(list(L.ROLE_MAILBOXES)))


def tie_hosts(named: DataFrame) -> DataFrame:
    """Addresses and sites of known people and companies follow their surrogates: the local
    part is the person's or stays if it names an office, the host is the company's.
    People are met by the name that the local part hints at; companies in a prefix join,
    bucketed by the first three letters, where the longest common name wins."""
    from spanveil.operators.detectors import name_hint

    kind = F.col("pii_type")
    local = F.substring_index("canonical_text", "@", 1)
    host = F.when(kind == "EMAIL", F.lower(F.substring_index("canonical_text", "@", -1))).otherwise(host_of(F.col("canonical_text")))
    stem = F.regexp_replace(F.regexp_extract(host, r"(?:^|\.)([a-z0-9\-]+)(?:\.(?:co|com|org|net|gov|ac|edu))?\.[a-z]+$", 1), "-", "")
    hosts = named.where(kind.isin("EMAIL", "URL")).withColumn("hint", F.when(kind == "EMAIL", norm(name_hint(local)))).withColumn("stem", stem)
    people = named.where("pii_type = 'PERSON'").select(F.col("scope").alias("ps"), F.col("canonical_key").alias("pk"), F.lower(F.regexp_replace("surrogate", r"[^\p{L}\d]+", ".")).alias("person"))
    firms = named.where("pii_type = 'ORGANIZATION'").select(F.col("scope").alias("os"), squash(F.col("canonical_text")).alias("name"), squash(F.col("surrogate")).alias("host"))
    met = hosts.join(people, (F.col("scope") == F.col("ps")) & (F.col("hint") == F.col("pk")), "left")
    near = (F.col("scope") == F.col("os")) & (F.substring("stem", 1, 3) == F.substring("name", 1, 3)) & (F.col("stem").startswith(F.col("name")) | F.col("name").startswith(F.col("stem"))) & (F.length("stem") >= 3)
    best = met.join(firms, near).groupBy("scope", "pii_type", "canonical_key").agg(F.max_by("host", F.struct(F.least(F.length("name"), F.length("stem")), "host")).alias("host"))
    tied = met.join(best, ["scope", "pii_type", "canonical_key"], "left")
    kept = F.when(role_mailbox(local), F.lower(local))
    mail = F.concat(F.coalesce("person", kept, F.substring_index("surrogate", "@", 1)), F.lit("@"), F.coalesce(F.concat("host", F.lit(".example")), F.lit("example.com")))
    lead = F.regexp_extract("canonical_text", r"(?i)^(?:[a-z]+://)?(?:www\. ?)?", 0)
    path = F.regexp_extract("canonical_text", r"(?i)^(?:[a-z]+://)?[^/?#]*([/?#].*)$", 1)
    site = F.when(F.col("host").isNotNull(), F.concat(lead, "host", F.lit(".example"), path)).otherwise(F.col("surrogate"))
    out = tied.withColumn("surrogate", F.when(kind == "EMAIL", mail).otherwise(site))
    return named.where(~kind.isin("EMAIL", "URL")).unionByName(out.select(*named.columns))


def part_of(part: Column, whole: Column, fake: Column) -> Column:
    """The words of the surrogate where the part's words stand in the whole; else all of it."""
    split = lambda x: F.split(F.trim(x), r"(?U)\s+")
    places = F.transform(split(part), lambda w: F.array_position(F.transform(split(whole), lambda x: norm(x)), norm(w)))
    fits = F.forall(places, lambda p: p > 0) & (F.size(split(whole)) == F.size(split(fake)))
    return F.when(fits, F.array_join(F.transform(places, lambda p: F.get(split(fake), p.cast("int") - 1)), " ")).otherwise(fake)


def replacements(spans: DataFrame, gazetteer: DataFrame, config: Config) -> DataFrame:
    """Resolved spans with canonical_key, canonical_text and surrogate, in the mention's case."""
    from spanveil.operators.gazetteer import canonical, scope_of

    names = canonical(gazetteer).select(F.col("scope").alias("gs"), F.col("key").alias("gk"), "canonical_key")
    texts = gazetteer.select(F.col("scope").alias("ts"), F.col("key").alias("tk"), F.col("surface").alias("canonical_surface"))
    s = spans.withColumn("scope", scope_of(config)).withColumn("norm_key", norm(F.col("text")))
    s = s.join(names, (F.col("scope") == F.col("gs")) & (F.col("norm_key") == F.col("gk")), "left").withColumn("canonical_key", F.coalesce("canonical_key", "norm_key")).drop("gs", "gk")
    s = s.join(texts, (F.col("scope") == F.col("ts")) & (F.col("canonical_key") == F.col("tk")), "left").drop("ts", "tk")
    entities = s.groupBy("scope", "pii_type", "canonical_key").agg(F.coalesce(F.max("canonical_surface"), F.max("text")).alias("canonical_text"))
    named = tie_hosts(entity_surrogates(entities, config))
    out = s.drop("canonical_surface").join(named, ["scope", "pii_type", "canonical_key"])
    whole = F.when(F.col("norm_key") != F.col("canonical_key"), part_of(F.col("text"), F.col("canonical_text"), F.col("surrogate"))).otherwise(F.col("surrogate"))
    cased = F.when(F.col("pii_type").isin("PERSON", "ORGANIZATION", "ADDRESS") & (case_style(F.col("text")) != case_style(F.col("canonical_text"))), match_case(whole, F.col("text"))).otherwise(whole)
    return out.withColumn("surrogate", cased).drop("norm_key")
