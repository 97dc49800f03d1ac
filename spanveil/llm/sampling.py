"""A bounded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import small

#: The share that the first, cheap cut aims at, times the rows wanted.
MARGIN = 2.0


def choose(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, those of the smallest hash of doc_id and, if
    there is one, text.

    Classes are counted with partial sums; a hash threshold for each class leaves
    about twice the rows wanted, whatever the size of the table, and only these are
    ranked.  What is left as a tie is the same row twice."""
    counts = labelled.groupBy(label).agg(F.count("*").alias("class_size")).withColumnRenamed(label, "class_label")
    text = [F.xxhash64("text")] if "text" in labelled.columns else []
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11), *text)
    unit = F.pmod(hashed, F.lit(1 << 20)) / F.lit(float(1 << 20))
    by = Window.partitionBy(label).orderBy("unit", "doc_id", *text)
    thin = labelled.withColumn("unit", unit).join(small(counts, "classes"), F.col(label) == F.col("class_label")).where(F.col("unit") * F.col("class_size") < MARGIN * per_class)
    return thin.withColumn("place", F.row_number().over(by)).where(F.col("place") <= per_class).drop("unit", "place", "class_label", "class_size")
