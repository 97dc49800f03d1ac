"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of every operator here, as Java patterns.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"

#: The hash tables of a shuffle join grow with the partition, so the number of
#: partitions follows the session (AQE coalesces what turns out to be small).


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def with_key(docs: DataFrame, *columns: str) -> DataFrame:
    """Add ``k1, k2``: hashes of doc_id and of the text.  Rows that agree in both have
    the same result in every operator here, so the pair can stand for the row
    even when ids repeat or are null; copies under other ids get other keys,
    so a group of copies does not meet in one task."""
    return docs.select(
        *[F.col(c) for c in columns],
        F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)).alias("k1"),
        F.xxhash64("text", F.lit(7)).alias("k2"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """``row, k1, k2``: all columns of ``docs`` in one struct, which no name can clash with,
    and the keys of :func:`with_key`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.select("row", F.xxhash64(F.col("row.doc_id").cast("string"), F.lit(1)).alias("k1"), F.xxhash64("row.text", F.lit(7)).alias("k2"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns that :func:`packed` put into ``row``."""
    return rows.select("row.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a
    temporary one will do if all run on one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/spanveil-shared"
    return found.rstrip("/")


#: Where the tables that :func:`cut` wrote lie, by the frame that it returned.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df``, in folders by the columns ``by``, to the shared folder and read it
    back: lineage ends there and a lost executor costs nothing that was written.  The
    files go with :func:`drop_cut`, or when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


#: Tables of up to so many rows are broadcast (each is counted first); larger ones are
#: shuffled, where Spark's runtime Bloom filters keep foreign keys out.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written; to be broadcast if it has few enough rows."""
    out = cut(df, tag)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """A frame that :func:`cut` returned, its columns under other names."""
    out = df.toDF(*names)
    _WRITTEN[out] = _WRITTEN.pop(df)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`cut` returned."""
    spark, path = df.sparkSession, _WRITTEN.pop(df)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = target.getFileSystem(spark._jsc.hadoopConfiguration())
    filesystem.delete(target, True)
    filesystem.cancelDeleteOnExit(target)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionAll(x)
    return out


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller slices of Arrow batches, so that what is decoded at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
