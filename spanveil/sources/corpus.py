"""A labelled synthetic corpus of invented values, with negatives of each family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (text, ((type, value), ..)); texts without values are negatives.
CASES: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = (
    ("Applicant SSN 321-54-9876 on file.", (("SSN", "321-54-9876"),)),
    ("Her social security number is 457552462.", (("SSN", "457552462"),)),
    ("SSN: 212 09 9999", (("SSN", "212 09 9999"),)),
    ("Two numbers, 321-54-9876 and 219-09-9999.", (("SSN", "321-54-9876"), ("SSN", "219-09-9999"))),
    ("Charged to card 4111 1111 1111 1111 today.", (("CREDIT_CARD", "4111 1111 1111 1111"),)),
    ("Amex 378282246310005", (("CREDIT_CARD", "378282246310005"),)),
    ("Use 5555-5555-5555-4444 or 6011-1111-1111-1117.", (("CREDIT_CARD", "5555-5555-5555-4444"), ("CREDIT_CARD", "6011-1111-1111-1117"))),
    ("Date of Birth: 12 March 1971", (("DOB", "12 March 1971"),)),
    ("DOB 04/11/1980, clerk", (("DOB", "04/11/1980"),)),
    ("He was born on 1985-07-30 in Leeds.", (("DOB", "1985-07-30"),)),
    ("Server 192.168.10.4 answered.", (("IP_ADDRESS", "192.168.10.4"),)),
    ("Peer 2001:db8::8a2e:370:7334 is up", (("IP_ADDRESS", "2001:db8::8a2e:370:7334"),)),
    ("From 10.0.0.1 to 10.0.0.254.", (("IP_ADDRESS", "10.0.0.1"), ("IP_ADDRESS", "10.0.0.254"))),
    ("SSN 321-54-9876, mail q.zorin@example.org", (("SSN", "321-54-9876"), ("EMAIL", "q.zorin@example.org"))),
    ("Call +44 20 7946 0958 from 10.1.2.3", (("PHONE", "+44 20 7946 0958"), ("IP_ADDRESS", "10.1.2.3"))),
    ("SSN 000-12-3456", ()),
    ("SSN 666-12-3456", ()),
    ("SSN 912-12-3456", ()),
    ("Number 321-00-9876", ()),
    ("Number 321-54-0000", ()),
    ("Digits 321 54 9876 in a table", ()),
    ("An amount of 457552462 units", ()),
    ("Card 4111 1111 1111 1112", ()),
    ("Shares 1234567890123456", ()),
    ("Count 1111111111111117", ()),
    ("Incorporated on 12 March 1971", ()),
    ("Resolution dated 04/11/1980", ()),
    ("Closing on 1985-07-30", ()),
    ("Fiscal ended March 31, 2024", ()),
    ("Release version 1.2.3.4", ()),
    ("Clause 10.2.3.1 applies", ()),
    ("Octets 300.1.2.3", ()),
    ("Grew 10.5.2.1 % a year", ()),
)


def load(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Segments and gold spans.  A value that is not in its text is an error."""
    segments, gold = [], []
    for i, (text, values) in enumerate(CASES):
        segments.append((f"case{i}", 0, f"synthetic/{i}", text, f"case {i}", "paragraph", None, None))
        for kind, value in values:
            start = text.index(value)
            gold.append((f"synthetic/{i}", kind, start, start + len(value), value))
    from spanveil.sources.segments import SEGMENT

    return spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(gold, "key string, pii_type string, start int, end int, text string")
