"""Segments from tables: one row for each text that detectors look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "doc_id string, seq long, key string, text string, location string, kind string, section string, column_header string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _segments(df: DataFrame, doc: Column, seq: Column, text: Column, kind: str, header: Column | None = None) -> DataFrame:
    key = F.concat_ws("/", doc.cast("string"), seq.cast("string"))
    none = F.lit(None).cast("string")
    return df.select(doc.cast("string").alias("doc_id"), seq.cast("long").alias("seq"), key.alias("key"), text.alias("text"), F.concat(F.lit(f"{kind} "), key).alias("location"), F.lit(kind).alias("kind"), none.alias("section"), (none if header is None else header).alias("column_header"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(table(spark, sf_dir, "documents"), F.col("doc_id"), F.lit(0), F.col("text"), "paragraph")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn"), F.col("text"), "turn")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(table(spark, sf_dir, "pages"), F.col("page_id"), F.lit(0), F.col("html"), "html")


def cells(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """One table-cell segment for each cell; the column name is its header."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("header"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)]))
    x = df.select(F.col(id_column), pairs.alias("c"))
    return _segments(x, F.col(id_column), F.col("c.i"), F.col("c.text"), "table-cell", F.col("c.header"))


def carry_sections(blocks: DataFrame) -> DataFrame:
    """A heading is the section of all that follows it in its document."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w))


def attach_headers(cells_: DataFrame) -> DataFrame:
    """Row 0 gives column headers, column 0 row headers; row 0 and column 0 have none themselves."""
    col, row = Window.partitionBy("doc_id", "table_index", "col_index"), Window.partitionBy("doc_id", "table_index", "row_index")
    return cells_.withColumn("column_header", F.when(F.col("row_index") > 0, F.max(F.when(F.col("row_index") == 0, F.col("text"))).over(col))).withColumn("row_header", F.when(F.col("col_index") > 0, F.max(F.when(F.col("col_index") == 0, F.col("text"))).over(row)))


def merged_cells(cells_: DataFrame) -> DataFrame:
    """A merged cell is one segment, where it first stands."""
    w = Window.partitionBy("doc_id", "cell_path").orderBy("row_index", "col_index")
    return cells_.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def run_offsets(runs: DataFrame) -> DataFrame:
    """``start, end`` of each run inside its segment."""
    w = Window.partitionBy("doc_id", "key").orderBy("run_ix")
    end = F.sum(F.length("run_text")).over(w)
    return runs.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("run_text")).cast("int"))


def assemble(runs: DataFrame) -> DataFrame:
    """Segments from their runs; blank ones are dropped."""
    x = runs.groupBy("doc_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", "run_text"))), lambda r: r["run_text"]), "").alias("text"))
    return x.where(F.trim("text") != "")


def stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("kind").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("characters"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled corpus (JSON lines with index, key, stratum, location, text and spans)."""
    schema = "index int, key string, stratum string, location string, text string, spans array<struct<pii_type:string,start:int,end:int,text:string>>"
    return spark.read.schema(schema).json(path)


def gold_spans(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.explode("spans").alias("s")).select("key", "s.pii_type", "s.start", "s.end", "s.text")
