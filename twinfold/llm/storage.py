"""Lineage cuts: write a table under the shared checkpoint folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.session import run_dir


def cut(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in ``spark.checkpoint.dir`` and read again with its own schema.

    The files outlive every executor, so whatever reads them never recomputes what came before.
    """
    path = run_dir(spark, f"llm-{label}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def number_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``row_id`` (a long of its own for every row) and ``rank``; rows in order of (rank, row_id) are in doc_id order.

    The doc_id is the row_id where it is a whole number that names its row alone (the usual case: two narrow scans and no
    copy). Otherwise rows are numbered once and written down, so later reads see the same numbers.
    """
    number = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    doc_id = F.col(id_col)
    if number and docs.where(doc_id.isNull() | (doc_id < 0)).isEmpty() and docs.groupBy(doc_id).agg(
            F.count("*").alias("rows")).where(F.col("rows") > 1).isEmpty():
        return docs.withColumn("row_id", doc_id.cast("long")).withColumn("rank", F.lit(0).cast("long"))
    rank = F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1)) if number else F.lit(0).cast("long")
    return cut(spark, docs.withColumn("row_id", F.monotonically_increasing_id()).withColumn("rank", rank), "rows")


def broadcast_if_small(table: DataFrame, max_rows: int) -> DataFrame:
    """``table`` (narrow rows, cheap to count), marked for broadcast if it has at most ``max_rows`` rows."""
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table
