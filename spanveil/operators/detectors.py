"""Pass-1 detectors as column expressions, and their registry.

A detector maps a segment to an array of spans.  All native ones are evaluated in one
projection over one scan: their arrays are concatenated and exploded together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.config import SPAN, Config
from spanveil.functions import lexicons as L
from spanveil.functions.text import after, before, digits, distinct_digits, host_of, matches, norm, verhoeff



@dataclass(frozen=True)
class Detector:
    name: str
    types: tuple[str, ...]
    pass_number: int
    build: Callable[[Config], Column]


REGISTRY: dict[str, Detector] = {}


def register(name: str, *types: str, pass_number: int = 1):
    def put(build: Callable[[Config], Column]):
        if name in REGISTRY:
            raise ValueError(f"detector {name} is registered already")
        REGISTRY[name] = Detector(name, types, pass_number, build)
        return build

    return put


def active(config: Config) -> list[Detector]:
    """Detectors that can give a wanted type, in a fixed order; others never enter the plan."""
    return [d for _, d in sorted(REGISTRY.items()) if d.name not in config.disabled and set(d.types) & set(config.types)]


def any_of(words, sort: bool = True) -> str:
    """An alternation of plain words, longest first."""
    return "|".join(("\\Q" + w + "\\E") for w in (sorted(words, key=lambda w: (-len(w), w)) if sort else words))




def spans(found: Column, kind: str, detector: str, confidence: float | Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches -> spans, without those that ``keep`` refuses."""
    if keep is not None:
        found = F.filter(found, lambda m: F.coalesce(keep(m), F.lit(False)))
    level = confidence if callable(confidence) else lambda _: F.lit(float(confidence))
    made = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.lit(kind).alias("pii_type"), F.lit(detector).alias("detector"), level(m).cast("double").alias("confidence")))
    return made.cast(f"array<{SPAN}>")


def trimmed(found: Column, tail: str) -> Column:
    """Matches without the given characters at the end."""
    cut = lambda m: F.rtrim(m["text"], F.lit(tail))
    return F.filter(F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(cut(m))).alias("end"), cut(m).alias("text"))), lambda m: m["end"] > m["start"])


#: A dot-atom of letters, digits and the signs that mail hosts allow; labels of letters, digits
#: and inner hyphens; a last label of letters.
MAIL_ATOM = r"[0-9A-Za-z_%+\-]+"
HOST_LABEL = r"[0-9A-Za-z]+(?:-+[0-9A-Za-z]+)*"
EMAIL_BODY = rf"{MAIL_ATOM}(?:\.{MAIL_ATOM})*@(?:{HOST_LABEL}\.)+[A-Za-z]{{2,}}"
EMAIL = rf"(?U)(?<![\w.%+\-]){EMAIL_BODY}(?![\w\-])"
#: Justified text may put a blank after a dot of the host.
HOST_DOT = r"(?:\.|\. (?=[a-z0-9\-]+\.[a-z]|(?:com|net|org|in|co|gov|edu|io)\b))"
URL = rf"(?Ui)(?<![\w@])(?:(?:https?|ftp)://|www\. ?)[a-z0-9\-]+(?:{HOST_DOT}[a-z0-9\-]+)+(?::\d+)?(?:[/?#][^\s<>\"']*)?"
SSN_BODY = r"(?!000|666|9\d\d)\d{3}{sep}(?!00)\d{2}{sep}(?!0000)\d{4}"
SSN = r"(?U)(?<![\w\-])" + SSN_BODY.replace("{sep}", r"[\-–]") + r"(?![\w\-])"
SSN_LABELLED = r"(?Ui)(\b(?:ssn|social security(?: (?:number|no\.?|#))?)(?:\s+(?:is|was|of|as|reads|(?:given|shown|listed|recorded|stated) as|on (?:file|record) is))?\s*[:#\-]?\s*)(" + SSN_BODY.replace("{sep}", r"[\- –]?") + r")(?![\w\-])"
#: A card number has 12 to 19 digits (ISO/IEC 7812), with a blank or hyphen between any two.
CARD_BODY = r"\d(?:[ \-]?\d){11,18}"
CARD = rf"(?U)(?<![\d.\-]){CARD_BODY}(?!\d|[.\-]\d)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?U)(?<![\w.\-])(?:{OCTET}\.){{3}}{OCTET}(?![\w\-]|\.\d)"
H = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?U)(?<![\w:.])(?:(?:{H}:){{7}}{H}|(?=(?:[0-9A-Fa-f]*:){{2,7}}[0-9A-Fa-f]*(?![\w:]))(?:{H}(?::{H}){{0,6}})?::(?:{H}(?::{H}){{0,6}})?)(?:/(?:12[0-8]|1[01]\d|\d{{1,2}})(?!\d))?(?![\w:])"
#: International numbers (E.164): a plus and 8 to 15 digits, the first not 0, with up to two
#: blanks, dots, hyphens or brackets before each.
PHONE_BODY = r"\+[1-9](?:[ .()\-]{0,2}\d){7,14}"
PHONE_CC = rf"(?U)(?<![\w+]){PHONE_BODY}(?!\d)"
#: National numbers: the trunk digit 0, an area code of two to four digits, and the subscriber's.
PHONE_TRUNK = r"(?U)(?<![\w.+\-])0[1-9]\d{1,3}[ \-]\d{3,4}[ \-]?\d{3,4}(?!\d|\.\d)"
PHONE_NUMBER = r"\+?\d[\d ()\-]{6,20}\d"
PHONE_LABEL = rf"(?Ui)(\b(?:tel(?:ephone)?|phone|mobile|mob|cell|fax|contact no)\b\.?(?:\s*(?:nos?|number)\b\.?)?\s*[:\-]?\s*)({PHONE_NUMBER}(?:\s*(?:[/,;]|or|and)\s*{PHONE_NUMBER})*)"
MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTHS},?\s+\d{{4}}|{MONTHS}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{4}}(?:-\d{{1,2}}-|/\d{{1,2}}/|\.\d{{1,2}}\.)\d{{1,2}}|\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}}|{MONTHS}\s+\d{{4}})"
DOB_LABEL = rf"(?Ui)(\b(?:date of birth|birth ?date|d\.?o\.?b\b\.?|born on)\s*[:\-]?\s*(?:is\s+)?)({DATE})(?![\w/])"
DOB_BORN = rf"(?Ui)(\bborn\s+(?:(?:on|in)\s+(?:the\s+)?)?|\bb\.\s*)({DATE})(?![\w/])"
BIRTH_CUE = r"(?Ui)\b(?:born|birth(?:day|date|place)?|age[ds]?|years? old)\b"
NAME_TOKEN = r"(?:\p{Lu}\.|\p{Lu}[\p{L}'’\-]+)"
NAME = rf"{NAME_TOKEN}(?:\s+(?:(?:de|da|van|von|der|bin|al|la|le)\s+)?{NAME_TOKEN}){{1,4}}"


def has_digit() -> Column:
    return F.col("text").rlike("[0-9]")


@register("email.regex", "EMAIL")
def email(config: Config) -> Column:
    return spans(matches(F.col("text"), EMAIL, guard=F.col("text").contains("@")), "EMAIL", "email.regex", 1.0)


def is_public_domain(host: Column) -> Column:
    out = F.lit(False)
    for d in L.PUBLIC_DOMAINS:
        out = out | (host == d) | host.endswith("." + d)
    return out


@register("url.regex", "URL")
def url(config: Config) -> Column:
    return spans(trimmed(matches(F.col("text"), URL, guard=F.col("text").contains("://") | F.lower(F.col("text")).contains("www.")), ".,;:!?)]}'\""), "URL", "url.regex", 1.0, lambda m: ~is_public_domain(host_of(m["text"])))


def plausible_phone(m: Column) -> Column:
    n = F.length(digits(m["text"]))
    lead = before(F.col("text"), m["start"], 3)
    register_label = before(F.col("text"), m["start"], 40).rlike(r"(?i)(?:registration|membership|certificate|licen[cs]e|firm|account|invoice|din|cin|pan)\s*(?:no\.?|number)?\s*[:\-]?\s*$")
    return n.between(8, 15) & (distinct_digits(m["text"]) > 2) & ~lead.rlike("[₹$%]") & ~register_label


@register("phone.pattern", "PHONE")
def phone(config: Config) -> Column:
    runs = matches(F.col("text"), PHONE_LABEL, 2, 2, has_digit())
    moved = lambda r: F.transform(matches(r["text"], PHONE_NUMBER), lambda m: F.struct((r["start"] + m["start"]).alias("start"), (r["start"] + m["end"]).alias("end"), m["text"].alias("text")))
    labelled = F.flatten(F.transform(runs, moved))
    parts = [(matches(F.col("text"), PHONE_CC, guard=F.col("text").contains("+")), 0.97), (matches(F.col("text"), PHONE_TRUNK, guard=F.col("text").rlike("0[1-9]")), 0.90), (labelled, 1.0)]
    return F.concat(*[spans(x, "PHONE", "phone.pattern", c, plausible_phone) for x, c in parts])


@register("ssn.pattern", "SSN")
def ssn(config: Config) -> Column:
    return F.concat(spans(matches(F.col("text"), SSN, guard=has_digit()), "SSN", "ssn.pattern", 0.95), spans(matches(F.col("text"), SSN_LABELLED, 2, 2, has_digit()), "SSN", "ssn.pattern", 1.0))


def luhn(text: Column) -> Column:
    return F.call_function("luhn_check", digits(text)) & (F.length(digits(text)) >= 12)


def card_scheme(text: Column) -> Column:
    """The first scheme whose lengths and prefixes fit, or null."""
    d = digits(text)
    n = F.length(d)
    return (
        F.when(n.isin(13, 16, 19) & d.rlike("^4"), "visa")
        .when((n == 16) & d.rlike("^(?:5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))"), "mastercard")
        .when((n == 15) & d.rlike("^3[47]"), "amex")
        .when(n.isin(16, 19) & d.rlike("^(?:6011|65|64[4-9])"), "discover")
        .when((n == 14) & d.rlike("^3(?:0[0-5]|[68])"), "diners")
        .when(n.between(16, 19) & d.rlike("^35(?:2[89]|[3-8])"), "jcb")
        .when((n == 16) & d.rlike("^(?:60|81|82|508)"), "rupay")
        .when(n.between(12, 19) & d.rlike("^(?:50|5[6-9]|6)"), "maestro")
    )


@register("credit_card.luhn", "CREDIT_CARD")
def card(config: Config) -> Column:
    labelled = lambda m: before(F.col("text"), m["start"], 40).rlike(r"(?i)(?:card|visa|master ?card|amex|debit|credit)")
    strong = lambda m: m["text"].rlike("[ -]") | labelled(m)
    entropy = lambda m: (distinct_digits(m["text"]) >= 4) & ~digits(m["text"]).rlike(r"(\d)\1{5}")
    keep = lambda m: luhn(m["text"]) & card_scheme(m["text"]).isNotNull() & (strong(m) | (F.length(m["text"]).isin(15, 16) & entropy(m)))
    return spans(matches(F.col("text"), CARD, guard=has_digit()), "CREDIT_CARD", "credit_card.luhn", lambda m: F.when(strong(m), 1.0).otherwise(0.85), keep)


def ip_allowed(m: Column) -> Column:
    cue = before(F.col("text"), m["start"], 14).rlike(r"(?i)\b(?:version|ver\.?|v|clause|section|para(?:graph)?|schedule|standard|release|rule|article)\s*$")
    unit = after(F.col("text"), m["end"], 16).rlike(r"(?i)^\s*(?:%|million|crore|lakh|kg|mm|km|months?|years?|days?)")
    return ~cue & ~unit


@register("ip.pattern", "IP_ADDRESS")
def ip(config: Config) -> Column:
    v6 = lambda m: ip_allowed(m) & (F.length(m["text"]) > 2)
    return F.concat(spans(matches(F.col("text"), IPV4, guard=F.col("text").rlike("[0-9][.][0-9]")), "IP_ADDRESS", "ip.pattern", 1.0, ip_allowed), spans(matches(F.col("text"), IPV6, guard=F.col("text").contains("::") | F.col("text").rlike("(?:[0-9A-Fa-f]+:){2}")), "IP_ADDRESS", "ip.pattern", 0.95, v6))


#: Identity documents: pattern, confidence, and the label that must stand before it (none: no label).
ID_RULES = (
    ("cin", r"[UuLl]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}", 1.0, ""),
    ("gstin", r"\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]", 1.0, ""),
    ("sebi", r"IN[A-Z]\d{9}", 1.0, ""),
    ("pan", r"[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]", 0.9, ""),
    ("aadhaar", r"[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}", 0.95, ""),
    ("din", r"\d{8}", 1.0, r"\bdin\b|director identification"),
    ("firm", r"\d{6}[A-Z]", 0.95, r"firm registration|\bfrn\b"),
    ("peer_review", r"\d{5,6}", 0.95, r"peer review"),
    ("membership", r"\d{5,6}", 0.9, r"membership"),
    ("passport", r"[A-Z]\d{7}", 0.95, r"passport"),
    ("driving_licence", r"[A-Z]{2}\d{2}[ -]?\d{11}", 0.95, r"driving licen[cs]e"),
    ("voter", r"[A-Z]{3}\d{7}", 0.9, r"voter|\bepic\b"),
)


def aadhaar_ok(text: Column) -> Column:
    return F.when(F.length(digits(text)) == 12, (verhoeff(digits(text)) == 0) & (distinct_digits(text) > 2)).otherwise(False)


@register("national_id.rules", "NATIONAL_ID")
def national_id(config: Config) -> Column:
    out = []
    for kind, pattern, confidence, label in ID_RULES:
        def keep(m: Column, kind=kind, label=label) -> Column:
            good = aadhaar_ok(m["text"]) if kind == "aadhaar" else F.lit(True)
            return good & before(F.col("text"), m["start"], 45).rlike("(?i)" + label) if label else good

        out.append(spans(matches(F.col("text"), rf"(?U)(?<![\w]){pattern}(?![\w])", guard=has_digit()), "NATIONAL_ID", "national_id.rules", confidence, lambda m, k=keep: k(m)))
    header, cell = norm(F.col("column_header")), F.trim(F.col("text"))
    fits = F.lit(False)
    for label, kind in (("din|director identification number", "din"), ("pan|permanent account number", "pan"), ("cin", "cin"), ("aadhaar", "aadhaar")):
        shape = next(p for k, p, _, _ in ID_RULES if k == kind)
        fits = fits | (header.rlike(rf"\b(?:{label})\b") & cell.rlike(f"^(?:{shape})$"))
    return F.concat(*out, whole_cell(F.coalesce(fits, F.lit(False)), "NATIONAL_ID", "national_id.rules"))


def whole_cell(condition: Column, kind: str, detector: str, confidence: float = 1.0) -> Column:
    """The trimmed cell as one span, if the condition holds."""
    start = F.length(F.col("text")) - F.length(F.ltrim(F.col("text")))
    one = F.array(F.struct(start.alias("start"), (start + F.length(F.trim(F.col("text")))).alias("end"), F.trim(F.col("text")).alias("text")))
    return F.when(condition, spans(one, kind, detector, confidence)).otherwise(F.array().cast(f"array<{SPAN}>"))


def plausible_year(text: Column, now: int) -> Column:
    years = F.regexp_extract_all(text, F.lit(r"(\d{4})"))
    return (F.size(years) == 0) | F.exists(years, lambda y: y.cast("int").between(now - 120, now))


@register("dob.contextual", "DOB")
def dob(config: Config) -> Column:
    keep = lambda m: plausible_year(m["text"], config.current_year)
    out = [spans(matches(F.col("text"), p, 2, 2, has_digit()), "DOB", "dob.contextual", 1.0, keep) for p in (DOB_LABEL, DOB_BORN)]
    if config.dob_mode == "contextual":
        cues = matches(F.col("text"), BIRTH_CUE)
        near = lambda m: keep(m) & F.exists(cues, lambda c: F.abs(c["start"] - m["start"]) <= 60)
        out.append(spans(matches(F.col("text"), rf"(?Ui)(?<![\w/]){DATE}(?![\w/])", guard=has_digit()), "DOB", "dob.contextual", 0.6, near))
    return F.concat(*out)


def looks_like_person(text: Column, single: bool = False) -> Column:
    """2 to 5 capitalised words (or one), none of which speaks for something else."""
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,"))))
    banned = sorted({*L.ADDRESS_WORDS, *L.DESIGNATIONS, *L.NON_PERSON_TOKENS, *L.PUBLIC_TOKENS, *L.LOCALITIES, *(s.lower() for s in L.ORG_SUFFIXES)})
    full = F.array_join(low, " ")
    return (
        F.size(words).between(1 if single else 2, 5)
        & ~text.rlike(r"\d")
        & ~F.exists(low, lambda w: w.isin(banned))
        & ~full.isin([*L.PUBLIC_BODIES, *L.STATES, *L.ROLE_PHRASES])
        & ~F.forall(low, lambda w: w.isin(list(L.GENERIC_WORDS)))
        & F.exists(low, lambda w: F.length(w) > 1)
        & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(list(L.NAME_PARTICLES)))
    )


def name_hint(local: Column) -> Column:
    """A person's name inside the local part of an address, or null; words that are no name
    (offices, firms, titles) are left out."""
    parts = F.filter(F.transform(F.split(local, r"[._\-+]"), lambda x: F.regexp_replace(x, r"\d+$", "")), lambda x: (x != "") & ~F.lower(x).isin(list(L.MAIL_NOISE)))
    fine = (
        F.size(parts).between(2, 3)
        & F.forall(parts, lambda x: x.rlike("^[A-Za-z]{2,}$"))
        & F.exists(parts, lambda x: F.length(x) > 2)
    )
    return F.when(fine, F.array_join(F.transform(parts, lambda x: F.initcap(F.lower(x))), " "))
