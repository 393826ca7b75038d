"""Tensors from any DataFrame, and dense index domains for non-dense keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.columns import index_columns
from twinfold.session import run_dir
from twinfold.spec import Tensor


def tensor_from(df: DataFrame, index_cols: Sequence[str | Column], value_col: str | Column,
                dims: Sequence[int] | None = None, name: str = "") -> DataFrame | Tensor:
    """Project any DataFrame to COO entries ``i0..i{N-1} long, y double``.

    Returns a :class:`Tensor` when ``dims`` is given, else the entries.
    Rows are kept as they are: duplicates stay separate observations.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in index_cols]
    val = F.col(value_col) if isinstance(value_col, str) else value_col
    entries = df.select(
        *[c.cast("long").alias(n) for c, n in zip(cols, index_columns(len(cols)))],
        val.cast("double").alias("y"),
    )
    if dims is None:
        return entries
    return Tensor(entries, tuple(int(d) for d in dims), name)


def index_mode(df: DataFrame, col: str, id_col: str = "idx") -> DataFrame:
    """Dense 0-based ids for the distinct non-null values of ``col``, in sorted order.

    Returns ``(value, idx)``. Distributed: distinct values are range
    partitioned, sorted and numbered inside each partition, and written once under
    the checkpoint folder; ids and the per-partition counts (one row per
    partition, combined into offsets) both come from that one written table, so they agree
    whatever the planner reuses.
    """
    spark = df.sparkSession
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    placed = (vals.repartitionByRange("value").sortWithinPartitions("value")
              .withColumn("_at", F.monotonically_increasing_id()))
    path = run_dir(spark, "index")
    placed.write.parquet(path)
    # monotonically_increasing_id: the partition above bit 33, the row below.
    numbered = spark.read.schema(placed.schema).parquet(path).select(
        "value", F.shiftright("_at", 33).alias("_pid"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_rn"))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return numbered.join(F.broadcast(offsets), "_pid").select(
        "value", (F.col("_off") + F.col("_rn")).cast("long").alias(id_col)
    )


def apply_index(df: DataFrame, col: str, ids: DataFrame, out_col: str | None = None) -> DataFrame:
    """Replace ``col`` by its dense id from :func:`index_mode` (inner equi-join)."""
    out = out_col or col
    joined = df.join(ids.withColumnRenamed("value", "_value"), F.col(col) == F.col("_value"))
    rest = [c for c in df.columns if c != col]
    return joined.select(*[F.col(c) for c in rest], F.col("idx").alias(out))
