"""Detection and redaction on streams of segments.

Pass 1 and resolution look at one segment at a time.  Spans that tie are resolved in the
segment's own array, so the query has no state and runs in append mode; pass 2 needs
a dictionary and takes a static one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.config import DEFAULT, SPAN, Config
from spanveil.operators import scanning  # noqa: F401
from spanveil.operators.detectors import active
from spanveil.operators.resolve import priority, resolve_claims


def resolved_array(config: Config) -> Column:
    """All spans of a segment, resolved without a shuffle."""
    spans = F.concat(*[d.build(config) for d in active(config)])
    wanted = F.filter(spans, lambda s: s["pii_type"].isin(list(config.types)) & (s["confidence"] >= config.min_confidence))
    ranked = F.transform(wanted, lambda s: F.struct(priority(s["pii_type"]).alias("p"), (s["start"] - s["end"]).alias("l"), s["start"].alias("s"), (-s["confidence"]).alias("c"), s["detector"].alias("d"), s.alias("x")))
    return resolve_claims(F.transform(F.array_sort(ranked), lambda r: r["x"].cast(SPAN)))


def detect_stream(segments: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``segments`` (streaming or not) -> resolved spans."""
    return segments.select("doc_id", "key", F.explode(resolved_array(config)).alias("s")).select("doc_id", "key", "s.*")


def count_windows(spans: DataFrame, time: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Spans by type in event-time windows; later rows than the watermark are dropped."""
    return spans.withWatermark(time, late).groupBy(F.window(time, width), "pii_type").count()
