"""Detectors on invented values: what each must find, and what it must leave alone."""

import pytest

from spanveil.config import DEFAULT, Config, parse_types
from spanveil.plans.pipeline import pass_one

SCHEMA = "doc_id string, seq long, key string, text string, location string, kind string, section string, column_header string"

FOUND = [
    ("mail q.zorin@example.org now", "EMAIL", "q.zorin@example.org", None),
    ("see https://www.fabrikam.com/a?b=1, or not", "URL", "https://www.fabrikam.com/a?b=1", None),
    ("call +44 20 7946 0958 today", "PHONE", "+44 20 7946 0958", None),
    ("call 020-79460958 today", "PHONE", "020-79460958", None),
    ("Tel: 98-7654-3210", "PHONE", "98-7654-3210", None),
    ("SSN 321-54-9876", "SSN", "321-54-9876", None),
    ("social security number: 321549876", "SSN", "321549876", None),
    ("paid by 4111 1111 1111 1111.", "CREDIT_CARD", "4111 1111 1111 1111", None),
    ("ref 4532015112830366 used", "CREDIT_CARD", "4532015112830366", None),
    ("from 10.20.30.40.", "IP_ADDRESS", "10.20.30.40", None),
    ("peer fe80::1ff:fe23:4567:890a up", "IP_ADDRESS", "fe80::1ff:fe23:4567:890a", None),
    ("Date of Birth: 12 March 1971", "DOB", "12 March 1971", None),
    ("born on 1971-03-12", "DOB", "1971-03-12", None),
    ("PAN ABCPE1234F", "NATIONAL_ID", "ABCPE1234F", None),
    ("DIN: 01234567", "NATIONAL_ID", "01234567", None),
    ("01234567", "NATIONAL_ID", "01234567", "DIN"),
    ("Mr. Orin Zelkova agreed", "PERSON", "Orin Zelkova", None),
    ("Contact Person: Nerys Vantongeren", "PERSON", "Nerys Vantongeren", None),
    ("Nerys Vantongeren, Managing Director", "PERSON", "Nerys Vantongeren", None),
    ("Nerys Vantongeren", "PERSON", "Nerys Vantongeren", "Name"),
    ("sold to Quorvex Dynamics Private Limited in May", "ORGANIZATION", "Quorvex Dynamics Private Limited", None),
    ("Office: Plot 12, Cedar Road, Andheri, Mumbai - 400 053", "ADDRESS", "Plot 12, Cedar Road, Andheri, Mumbai - 400 053", None),
    ("12 Cedar Road, Mumbai, Maharashtra", "ADDRESS", "12 Cedar Road, Mumbai, Maharashtra", "Address"),
]

CLEAN = [
    ("SSN 000-12-3456", "SSN"), ("SSN 666-12-3456", "SSN"), ("SSN 912-12-3456", "SSN"), ("id 321-00-9876", "SSN"), ("id 321-54-0000", "SSN"), ("id 321 54 9876", "SSN"),
    ("card 4111 1111 1111 1112", "CREDIT_CARD"), ("shares 1234567890123456", "CREDIT_CARD"),
    ("version 1.2.3.4", "IP_ADDRESS"), ("addr 300.1.2.3", "IP_ADDRESS"), ("para 1.2.3.4.5", "IP_ADDRESS"), ("at 12:30:45", "IP_ADDRESS"),
    ("incorporated on 12 March 1971", "DOB"), ("www.sebi.gov.in", "URL"), ("é a@b", "EMAIL"),
    ("Mr. of the", "PERSON"), ("Name of Road", "PERSON"), ("the Reserve Bank of India", "ORGANIZATION"), ("Our Company Limited", "ORGANIZATION"), ("the Company", "ORGANIZATION"),
    ("₹ 98765432", "PHONE"), ("amount 400 053", "ADDRESS"),
]


def run(spark, rows, config=DEFAULT):
    data = [(str(i), 0, f"{i}/0", text, "", "paragraph", None, header) for i, (text, header) in enumerate(rows)]
    out = {}
    for r in pass_one(spark.createDataFrame(data, SCHEMA), config).collect():
        out.setdefault(int(r["doc_id"]), []).append((r["pii_type"], r["start"], r["end"], r["text"]))
    return out


def test_positives(spark):
    got = run(spark, [(t, h) for t, _, _, h in FOUND])
    for i, (text, kind, value, _) in enumerate(FOUND):
        assert (kind, text.index(value), text.index(value) + len(value), value) in got.get(i, []), (text, got.get(i))


def test_negatives(spark):
    got = run(spark, [(t, None) for t, _ in CLEAN])
    for i, (text, kind) in enumerate(CLEAN):
        assert kind not in [k for k, *_ in got.get(i, [])], (text, got.get(i))


def test_offsets_are_code_points(spark):
    text = "😀é mail q.zorin@example.org"
    assert run(spark, [(text, None)])[0] == [("EMAIL", 8, 27, "q.zorin@example.org")]


def test_null_and_empty(spark):
    assert run(spark, [(None, None), ("", None)]) == {}


def test_contextual_dates(spark):
    rows = [("she was born in Leeds, 1971-03-12", None)]
    assert run(spark, rows) == {}
    assert [k for k, *_ in run(spark, rows, Config(dob_mode="contextual"))[0]] == ["DOB"]


def test_types(spark):
    assert parse_types("email, ssn") == ("EMAIL", "SSN")
    with pytest.raises(ValueError):
        parse_types("email,nothing")
    got = run(spark, [("SSN 321-54-9876 q@example.org", None)], DEFAULT.with_types("SSN"))
    assert [k for k, *_ in got[0]] == ["SSN", "SSN"]  # by its label and by its separators
