"""Registered queries of the engine's own operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.cases import CASES
from spanveil.config import DEFAULT, Config
from spanveil.functions import text as T
from spanveil.operators import detectors as D
from spanveil.operators import evaluate as E
from spanveil.operators import gazetteer as G
from spanveil.operators import resolve as R
from spanveil.operators import rewrite as W
from spanveil.operators import scanning as S
from spanveil.operators import surrogates as Z
from spanveil.plans import pipeline as P
from spanveil.sources import corpus
from spanveil.sources import segments as I
from spanveil.sources.ner import ner_spans
from spanveil.sources.store import keep
from spanveil.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def found(segments: DataFrame, spans: Column) -> DataFrame:
    """Spans of one detector: id, start, end, value."""
    return segments.where("text is not null").select("doc_id", F.explode(spans).alias("s")).select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.text").alias("value"))


# --- texts made from relational columns, the same in Spark and in SQL


def order_texts(spark, sf, text: Column, header: str | None = None) -> DataFrame:
    rows = I.table(spark, sf, "orders").withColumn("made", text)
    seg = I._segments(rows, F.col("o_orderkey"), F.lit(0), F.col("made"), "paragraph", None if header is None else F.lit(header))
    return seg


def three(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


SSN_TEXT = lambda: F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"), F.lit(" SSN "), three(F.col("o_custkey") % 999, 3), F.lit("-"), three(F.col("o_orderkey") % 100, 2), F.lit("-"), three(F.col("o_custkey") * 7 % 10000, 4), F.lit(" filed."))
DOB_TEXT = lambda: F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"), F.lit(", Date of Birth: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("; closed "), F.date_format("o_orderdate", "dd/MM/yyyy"))
PAN_TEXT = lambda: F.concat(F.lit("Quoted "), F.lit("ABC"), F.substring(F.lit("ABCFGHJLPTXYZ"), (F.col("o_orderkey") % 13 + 1).cast("int"), F.lit(1)), F.lit("K"), three(F.col("o_custkey") % 10000, 4), F.lit("Z in file"))
NAME_TEXT = lambda: F.concat(F.lit("Signed by Mr. "), F.element_at(F.array(*[F.lit(x) for x in ("Arlo", "Bram", "Cato", "Dane")]), (F.col("o_custkey") % 4 + 1).cast("int")), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("Velden", "Wexmoor", "Yardley")]), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit(" on page "), (F.col("o_orderkey") % 50).cast("string"))
ORG_TEXT = lambda: F.concat(F.lit("sold to "), F.element_at(F.array(*[F.lit(x) for x in ("Brenmar", "Calvex", "Dorintha")]), (F.col("o_custkey") % 3 + 1).cast("int")), F.lit(" Foundry Private Limited, order "), F.col("o_orderkey").cast("string"))
URL_TEXT = lambda: F.concat(F.lit("see https://www.host"), (F.col("o_custkey") % 97).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".example.com").otherwise(".gov.in"), F.lit("/p/"), F.col("o_orderkey").cast("string"), F.lit(", thanks"))


def case_segments(spark, sf) -> DataFrame:
    """One case of the table for each order, after the order's number."""
    at = (F.col("o_orderkey") % len(CASES) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), at)
    header = pick([h for _, h, _ in CASES])
    rows = I.table(spark, sf, "orders").withColumn("header", header)
    text = F.concat(F.when(F.col("header").isNull(), F.concat(F.lit("No "), F.col("o_orderkey").cast("string"), F.lit(": "))).otherwise(""), pick([t for t, _, _ in CASES]))
    return I._segments(rows, F.col("o_orderkey"), F.lit(0), text, "paragraph", F.col("header"))


@query
def detector_cases(spark, sf):
    """All detectors on texts with several spans, one or none."""
    spans = P.pass_one(case_segments(spark, sf))
    return spans.select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "pii_type", F.col("text").alias("value")).distinct()


@query
def resolved_cases(spark, sf):
    """Pass 1 and resolution on the cases."""
    return R.resolve(P.pass_one(case_segments(spark, sf)), DEFAULT).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "pii_type", F.col("text").alias("value"))


@query
def stream_cases(spark, sf):
    """The stateless plan of streams on the cases."""
    return stream.detect_stream(case_segments(spark, sf)).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "pii_type", F.col("text").alias("value"))


@query
def detector_counts_of_cases(spark, sf):
    return P.pass_one(case_segments(spark, sf)).select("doc_id", "start", "end", "pii_type").distinct().groupBy("pii_type").agg(F.count("*").alias("n"))


@query
def email_spans(spark, sf):
    return found(I.documents(spark, sf), D.email(DEFAULT))


@query
def email_spans_pages(spark, sf):
    return found(I.pages(spark, sf), D.email(DEFAULT))


@query
def ipv4_spans(spark, sf):
    return found(I.documents(spark, sf), F.filter(D.ip(DEFAULT), lambda s: s["confidence"] == 1.0))


@query
def ipv6_spans(spark, sf):
    text = F.concat(F.lit("peer 2001:db8::"), F.lower(F.hex(F.col("o_orderkey") % 65536)), F.lit(" and time 12:30:45"))
    return found(order_texts(spark, sf, text), F.filter(D.ip(DEFAULT), lambda s: s["confidence"] < 1.0))


@query
def phone_country_spans(spark, sf):
    return found(I.documents(spark, sf), F.filter(D.phone(DEFAULT), lambda s: s["confidence"] == 0.97))


@query
def card_spans(spark, sf):
    return found(I.documents(spark, sf), D.card(DEFAULT))


@query
def card_schemes(spark, sf):
    n = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("4", "51", "2720", "6011", "3528", "9")]), (F.col("o_orderkey") % 6 + 1).cast("int")))
    card = F.rpad(F.concat(n, F.col("o_custkey").cast("string")), 16, "0")
    return I.table(spark, sf, "orders").select(D.card_scheme(card).alias("scheme")).groupBy("scheme").agg(F.count("*").alias("n"))


@query
def luhn_valid(spark, sf):
    return I.table(spark, sf, "orders").select("o_orderkey", D.luhn(F.concat(F.lit("411111"), three(F.col("o_orderkey"), 10))).alias("valid"))


@query
def verhoeff_valid(spark, sf):
    """The digit that makes each number valid."""
    body = I.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("2"), three(F.col("o_orderkey"), 10)).alias("body"))
    fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: T.verhoeff(F.concat("body", d.cast("string"))) == 0)
    return body.select("o_orderkey", F.when(F.size(fits) == 1, F.get(fits, F.lit(0))).alias("digit"))


@query
def ssn_spans(spark, sf):
    return found(order_texts(spark, sf, SSN_TEXT()), F.filter(D.ssn(DEFAULT), lambda s: s["confidence"] == 1.0))


@query
def dob_spans(spark, sf):
    return found(order_texts(spark, sf, DOB_TEXT()), D.dob(DEFAULT))


@query
def dob_contextual_spans(spark, sf):
    return found(order_texts(spark, sf, F.concat(F.lit("She was born in Leeds, "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."))), D.dob(Config(dob_mode="contextual")))


@query
def pan_spans(spark, sf):
    return found(order_texts(spark, sf, PAN_TEXT()), D.national_id(DEFAULT))


@query
def labelled_id_spans(spark, sf):
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "DIN: ").otherwise("Ref: "), three(F.col("o_custkey"), 8), F.lit("."))
    return found(order_texts(spark, sf, text), D.national_id(DEFAULT))


@query
def column_header_ids(spark, sf):
    return found(order_texts(spark, sf, three(F.col("o_custkey"), 8), "DIN"), D.national_id(DEFAULT))


@query
def url_spans(spark, sf):
    return found(order_texts(spark, sf, URL_TEXT()), D.url(DEFAULT))


@query
def url_hosts(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", T.host_of(F.col("url")).alias("host"))


@query
def person_honorific(spark, sf):
    return found(order_texts(spark, sf, NAME_TEXT()), S.person(DEFAULT))


@query
def person_column_header(spark, sf):
    text = F.concat(F.lit("Arlo "), F.element_at(F.array(*[F.lit(x) for x in ("Velden", "Road", "Yardley")]), (F.col("o_orderkey") % 3 + 1).cast("int")))
    return found(order_texts(spark, sf, text, "Name"), S.person(DEFAULT))


@query
def org_suffix(spark, sf):
    return found(order_texts(spark, sf, ORG_TEXT()), S.organization(DEFAULT))


@query
def address_pin(spark, sf):
    text = F.concat(F.lit("Address: Plot "), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit(", Cedar Road, Pune - 411 "), three(F.col("o_orderkey") % 1000, 3), F.lit(" is closed"))
    return found(order_texts(spark, sf, text), S.address(DEFAULT))


@query
def name_hint_from_email(spark, sf):
    local = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("arlo.velden", "info", "bram_wexmoor", "x9")]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return I.table(spark, sf, "orders").select("o_orderkey", D.name_hint(local).alias("hint"))


@query
def norm_keys(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", T.norm(F.concat(F.lit("  “"), F.col("c_name"), F.lit("”   –  "), F.col("c_mktsegment"))).alias("k"))


@query
def case_styles(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", T.case_style(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))).alias("style"))


@query
def short_forms(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("Arlo J. Velden", "Bram Otto Wexmoor", "Cato Li")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return I.table(spark, sf, "orders").select("o_orderkey", F.array_join(G.short_forms(name), "|").alias("forms"))


@query
def brand_forms(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("Brenmar Foundry Private Limited", "BFX Calvex Ltd", "Dorintha Bank")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return I.table(spark, sf, "orders").select("o_orderkey", F.array_join(G.brand_forms(name), "|").alias("forms"))


def claims(spark, sf) -> DataFrame:
    """Claims with duplicates, from orders."""
    k = F.col("o_orderkey")
    start = (k % 40).cast("int")
    return I.table(spark, sf, "orders").select(
        (k % 300).cast("string").alias("doc_id"), (k % 7).cast("string").alias("key"), start.alias("start"), (start + k % 11 + 3).cast("int").alias("end"), F.rpad(F.lit("x"), (k % 11 + 3).cast("int"), "x").alias("text"),
        F.element_at(F.array(F.lit("PERSON"), F.lit("EMAIL"), F.lit("PHONE")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("pii_type"), F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("detector"), (F.lit(0.5) + F.col("o_custkey") % 5 / 10).alias("confidence"),
    )


@query
def confidence_floor(spark, sf):
    return R.confidence_floor(claims(spark, sf), 0.6).groupBy("pii_type").agg(F.count("*").alias("n"))


@query
def merge_duplicates(spark, sf):
    return R.merge_duplicates(claims(spark, sf)).select("doc_id", "key", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "pii_type", "detector", F.round("confidence", 4).alias("confidence"))


@query
def resolve_greedy(spark, sf):
    return R.resolve(claims(spark, sf), DEFAULT).select("doc_id", "key", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "pii_type")


@query
def disjointness_check(spark, sf):
    done = R.resolve(claims(spark, sf), DEFAULT)
    clash = R.overlapping(done).groupBy("doc_id", "key").agg(F.count("*").alias("m"))
    each = done.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("characters"))
    return each.join(clash, ["doc_id", "key"], "left").select("doc_id", "key", "n", "characters", F.coalesce("m", F.lit(0)).alias("n_overlapping"))


@query
def resolve_stats(spark, sf):
    return R.resolution_stats(claims(spark, sf), DEFAULT)


@query
def type_counts(spark, sf):
    """Spans of all native kinds that documents hold, by type, after both passes."""
    return P.detect(I.documents(spark, sf)).spans.groupBy("pii_type").agg(F.count("*").alias("n"))


@query
def detector_contribution(spark, sf):
    return P.pass_one(I.documents(spark, sf)).groupBy("detector").agg(F.count("*").alias("n"))


@query
def stream_spans(spark, sf):
    return stream.detect_stream(I.pages(spark, sf)).select("doc_id", "key", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "pii_type")


@query
def redact_documents(spark, sf):
    return P.redact(I.documents(spark, sf)).segments.select("doc_id", F.length("text").alias("before"), F.length("redacted").alias("after"), F.md5("redacted").alias("digest"))


@query
def leak_check(spark, sf):
    seg = I.documents(spark, sf)
    n = P.redact(seg).leaks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return seg.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_leaks"))


@query
def leaks_known(spark, sf):
    """A third of the texts still hold their value."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value = F.concat(F.lit("Zorvex"), (c % 50).cast("string"))
    rows = I.table(spark, sf, "orders").select((c % 200).cast("string").alias("doc_id"), k.cast("string").alias("key"), value.alias("text"), F.when(k % 3 == 0, F.concat(F.lit("kept "), value, F.lit(" here"))).otherwise("gone").alias("redacted"))
    return W.leaks(rows, rows)


@query
def audit_log(spark, sf):
    seg = I.documents(spark, sf)
    return W.audit_log(seg, P.redact(seg).replaced).select("location", "pii_type", "detector", "confidence", "start", "end", "original", "surrogate")


@query
def mapping_table(spark, sf):
    return W.mapping(P.redact(I.documents(spark, sf)).replaced)


@query
def run_summary(spark, sf):
    return P.summary(P.redact(I.documents(spark, sf)))


def name_segments(spark, sf) -> DataFrame:
    """A document for each customer's orders; the first introduces a name, others use its parts."""
    k = F.col("o_custkey")
    first = F.element_at(F.array(*[F.lit(x) for x in ("Arlo", "Bram", "Cato", "Dane")]), (k % 4 + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Mr. "), first, F.lit(" Velden agreed."))).otherwise(F.concat(F.lit("then Velden and "), F.upper(first), F.lit(" VELDEN left.")))
    return I._segments(I.table(spark, sf, "orders").withColumn("t", text), k, F.col("o_orderkey"), F.col("t"), "paragraph")


def names_dictionary(spark, sf) -> tuple[DataFrame, DataFrame]:
    seg = name_segments(spark, sf)
    return seg, keep(G.build(keep(P.pass_one(seg, seeding=True), "names"), seg, DEFAULT), "dictionary")


@query
def gazetteer_build(spark, sf):
    return names_dictionary(spark, sf)[1].select("scope", "key", "pii_type", F.coalesce("parent_key", F.lit("")).alias("parent_key"), "derived")


@query
def canonical_chain(spark, sf):
    return G.canonical(names_dictionary(spark, sf)[1]).groupBy("canonical_key").agg(F.count("*").alias("n"))


@query
def gazetteer_sweep(spark, sf):
    return G.sweep(*names_dictionary(spark, sf), DEFAULT).select("doc_id", "key", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "confidence")


@query
def gazetteer_sweep_ngrams(spark, sf):
    return G.sweep_ngrams(*names_dictionary(spark, sf), DEFAULT).select("doc_id", "key", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def surrogates_of(spark, sf, kind: str, text: Column) -> DataFrame:
    """``original, shape, surrogate, other``: shape is the surrogate with a 9 for each digit."""
    e = I.table(spark, sf, "orders").select(F.lit("corpus").alias("scope"), F.lit(kind).alias("pii_type"), T.norm(text).alias("canonical_key"), text.alias("canonical_text")).distinct()
    made = Z.entity_surrogates(e, Config(scope="corpus"))
    return made.select(F.col("canonical_text").alias("original"), F.regexp_replace("surrogate", "[0-9]", "9").alias("shape"), "surrogate", (F.col("surrogate") != F.col("canonical_text")).alias("other"))


CARD_TEXT = lambda: F.concat(F.lit("4111-11"), three(F.col("o_orderkey") % 100, 2), F.lit("-1111-"), three(F.col("o_custkey") % 10000, 4))


@query
def card_surrogate_luhn(spark, sf):
    return surrogates_of(spark, sf, "CREDIT_CARD", CARD_TEXT()).select("original", "shape", F.substring("surrogate", 1, 2).alias("lead"), D.luhn(F.col("surrogate")).alias("valid"), "other")


@query
def ssn_surrogate(spark, sf):
    text = F.concat(three(F.col("o_custkey") % 600 + 100, 3), F.lit("-12-"), three(F.col("o_orderkey") % 9999 + 1, 4))
    return surrogates_of(spark, sf, "SSN", text).select("original", "shape", F.col("surrogate").rlike(r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$").alias("valid"), "other")


@query
def phone_surrogate(spark, sf):
    text = F.concat(F.lit("+91 98765 "), three(F.col("o_custkey") % 100000, 5))
    return surrogates_of(spark, sf, "PHONE", text).select("original", "shape", F.substring("surrogate", 1, 3).alias("lead"), F.col("surrogate").rlike(r"^\+91 [2-9]").alias("valid"), "other")


@query
def surrogate_uniqueness(spark, sf):
    """How many entities share each one's surrogate."""
    e = I.table(spark, sf, "customer").select(F.lit("corpus").alias("scope"), F.lit("PERSON").alias("pii_type"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("canonical_key"), F.lit("Arlo Velden").alias("canonical_text"))
    made = Z.entity_surrogates(e, Config(scope="corpus"))
    return made.join(made.groupBy("surrogate").agg(F.count("*").alias("holders")), "surrogate").select("canonical_key", "holders")


@query
def digit_substitution(spark, sf):
    return I.table(spark, sf, "orders").select("o_orderkey", Z.refill(F.lit("(12) 34-56 789"), F.col("o_custkey").cast("string")).alias("filled"))


@query
def run_offset_map(spark, sf):
    return I.run_offsets(runs(spark, sf)).select("doc_id", "key", "run_ix", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def runs(spark, sf) -> DataFrame:
    """Three runs for each order; a value is split over all of them."""
    x = I.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(i).alias("run_ix"), t.alias("run_text")) for i, t in enumerate((F.lit("Mail zor"), F.lit("in@exa"), F.concat(F.lit("mple.org for "), F.col("o_orderstatus"))))])).alias("r"))
    return x.select("doc_id", "key", "r.run_ix", "r.run_text")


@query
def run_overlap_rewrite(spark, sf):
    r = I.run_offsets(runs(spark, sf))
    spans = r.select("doc_id", "key").distinct().select("doc_id", "key", F.lit(5).alias("start"), F.lit(22).alias("end"), F.lit("[MAIL]").alias("surrogate"))
    return W.rewrite_runs(r, spans).select("doc_id", "key", "run_ix", "new_text")


@query
def section_carry_forward(spark, sf):
    x = I.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 == 0, "heading").otherwise("paragraph").alias("kind"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("text"))
    return I.carry_sections(x).select("doc_id", "seq", F.coalesce("section", F.lit("")).alias("section"))


@query
def table_header_attach(spark, sf):
    x = I.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("doc_id"), F.col("l_orderkey").alias("table_index"), (F.col("l_linenumber") - 1).alias("row_index"), F.explode(F.array(*[F.struct(F.lit(i).alias("col_index"), t.cast("string").alias("text")) for i, t in enumerate((F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")))])).alias("c"))
    return I.attach_headers(x.select("doc_id", "table_index", "row_index", "c.*")).select("table_index", "row_index", "col_index", F.coalesce("column_header", F.lit("")).alias("column_header"), F.coalesce("row_header", F.lit("")).alias("row_header"))


@query
def merged_cell_dedupe(spark, sf):
    x = I.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("doc_id"), F.col("l_orderkey").cast("int").alias("row_index"), F.col("l_linenumber").alias("col_index"), (F.col("l_partkey") % 40).cast("string").alias("cell_path"))
    return I.merged_cells(x).select("doc_id", "cell_path", "row_index", "col_index")


@query
def doc_stats(spark, sf):
    seg = I.documents(spark, sf).unionByName(I.conversations(spark, sf)).unionByName(I.pages(spark, sf))
    return I.stats(seg)


@query
def cell_segments(spark, sf):
    return I.cells(I.table(spark, sf, "customer"), "c_custkey", "c_name", "c_mktsegment").select("doc_id", "seq", "text", "column_header")


def gold_pred(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold and predicted spans from orders: shifted, dropped and retyped ones."""
    k = F.col("o_orderkey")
    base = I.table(spark, sf, "orders").select(k.cast("string").alias("key"), F.element_at(F.array(F.lit("PERSON"), F.lit("EMAIL"), F.lit("PHONE")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("pii_type"), (k % 20).cast("int").alias("start"), (k % 20 + 5).cast("int").alias("end"), F.col("o_orderstatus").alias("stratum"), k.alias("k"))
    gold = base.where("k % 5 <> 0").select("key", "pii_type", "start", "end")
    pred = base.where("k % 7 <> 0").select("key", F.when(F.col("k") % 11 == 0, "SSN").otherwise(F.col("pii_type")).alias("pii_type"), (F.col("start") + F.when(F.col("k") % 3 == 0, 1).otherwise(0)).alias("start"), "end")
    texts = base.select("key", "stratum", F.rpad(F.lit("x"), 40, "x").alias("text"))
    return gold, pred, texts


@query
def strict_match(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.strict_match(g, p).select("key", "pii_type", "g_start", "g_end")


@query
def relaxed_match(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.relaxed_match(g, p)


@query
def relaxed_match_many(spark, sf):
    """Several gold and predicted spans of one type in a segment, which overlap each other."""
    k = F.col("o_orderkey")
    base = I.table(spark, sf, "orders").select((F.col("o_custkey") % 400).cast("string").alias("key"), F.when(k % 2 == 0, "PERSON").otherwise("EMAIL").alias("pii_type"), k)
    spans = lambda step, size: base.select("key", "pii_type", (k * step % 60).cast("int").alias("start"), (k * step % 60 + size + k % 6).cast("int").alias("end")).distinct()
    return E.relaxed_match(spans(7, 5), spans(11, 4))


@query
def prf_strict(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.scores(g, p, "strict").where("pii_type <> 'MACRO'")


@query
def prf_relaxed(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.scores(g, p, "relaxed")


@query
def char_confusion(spark, sf):
    g, p, t = gold_pred(spark, sf)
    return E.character_metrics(t, g, p)


@query
def segment_confusion(spark, sf):
    g, p, t = gold_pred(spark, sf)
    return E.segment_metrics(t, g, p)


@query
def by_stratum(spark, sf):
    g, p, t = gold_pred(spark, sf)
    return E.by_stratum(t, g, p, "strict")


@query
def error_rows_strict(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.errors(g, p, "strict").select("error", "key", "pii_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query
def error_rows_relaxed(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.errors(g, p, "relaxed").select("error", "key", "pii_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query
def missing_gold_values(spark, sf):
    """Annotations of customers by words that some of their texts lack."""
    c = I.table(spark, sf, "customer")
    gold = c.select(F.col("c_custkey").cast("string").alias("key"), F.lit("ORGANIZATION").alias("pii_type"), F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("text"))
    return E.missing_values(gold, c.select(F.col("c_custkey").cast("string").alias("key"), F.concat("c_name", F.lit(" in "), "c_mktsegment").alias("text")))


@query
def skipped_replacements(spark, sf):
    """Replacements of every order, segments of the even ones only."""
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("string").alias("key"), "o_orderkey")
    return W.skipped(o.where("o_orderkey % 2 = 0"), o).select("doc_id", "key")


@query
def type_confusion(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.type_confusion(g, p)


@query
def boundary_errors(spark, sf):
    g, p, _ = gold_pred(spark, sf)
    return E.boundary_errors(g, p)


@query
def stratified_sample(spark, sf):
    t = I.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("stratum"))
    return E.stratified_sample(t, {"F": 40, "O": 45}, 20260925, ("1", "2")).select("key", "stratum")


@query
def unknown_keys(spark, sf):
    g, _, t = gold_pred(spark, sf)
    return E.unknown_keys(g, t.where("stratum <> 'F'")).select("key", "pii_type")


@query
def nth_occurrence(spark, sf):
    return I.table(spark, sf, "customer").select("c_custkey", E.nth_occurrence(F.concat("c_name", "c_mktsegment"), F.lit("00"), 3).alias("at"))


@query
def topk_per_type(spark, sf):
    return E.top_per_type(claims(spark, sf).select("pii_type", F.concat("text", "doc_id").alias("text")))


@query
def synthetic_scores(spark, sf):
    """The engine against the labelled synthetic corpus."""
    seg, gold = corpus.load(spark)
    wanted = F.col("pii_type").isin("SSN", "CREDIT_CARD", "DOB", "IP_ADDRESS", "EMAIL", "PHONE")
    return E.scores(gold, P.detect(seg).spans.where(wanted), "strict").where("pii_type = 'MICRO'")


@query
def ner_people(spark, sf):
    seg = order_texts(spark, sf, NAME_TEXT())
    model = seg.select("doc_id", "key", F.lit(14).alias("start"), F.lit(40).alias("end"), F.substring("text", 15, 26).alias("text"), F.lit("PERSON").alias("label"))
    return ner_spans(model, seg).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("text").alias("value"))


@query
def ablation_scores(spark, sf):
    """The seven settings on the labelled synthetic corpus; no model's entities are given."""
    seg, gold = corpus.load(spark)
    return P.ablations(seg, gold).where("pii_type = 'MICRO'").select("config", "tp", "fp", "fn", "precision", "recall", "f1")
