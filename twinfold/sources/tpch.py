"""Coupled tensors built from the TPC-H-style test tables.

* X1: customers x parts, value = total quantity bought
  (``lineitem`` joined to ``orders``).
* X2: suppliers x parts, value = highest extended price / 1000.
* X3: parts x ship months, value = number of lines.

X1 and X2 share the part mode (mode 1); in X3 parts are mode 0. With ``three_mode=True`` each gains the
ship month (0..11) as mode 2. Dimension sizes come from the dimension tables,
whose keys are dense and 0-based. Training and validation cells are split by a
fixed hash of the coordinate, so both halves are whole, reproducible tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from twinfold.spec import Coupling, Tensor

SHIP_MONTHS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dims_of(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Row counts of the dimension tables (one small job)."""
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("t"))
        for t in ("customer", "part", "supplier")
    ]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("t").count()
    return {r.t: int(r["count"]) for r in df.collect()}


def _by_cell(lines: DataFrame, keys: list[Column], value: str, by: int) -> GroupedData:
    """Lines grouped by cell, moved once, to the task of their index on mode ``by``: what meets that mode's factor next need
    not move again.

    Few lines share a cell, so sums before that move would save nothing.
    """
    cells = lines.select(*keys, value).repartition(f"i{by}")
    return cells.groupBy(*[c for c in cells.columns if c != value])


def x1_entries(spark: SparkSession, sf_dir: str, three_mode: bool = False, by: int = 1) -> DataFrame:
    """Entries of X1, dealt over the tasks by their index on mode ``by`` (their part)."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    keys = [F.col("o_custkey").alias("i0"), F.col("l_partkey").alias("i1")]
    if three_mode:
        keys.append((F.month("l_shipdate") - 1).cast("long").alias("i2"))
    return _by_cell(j, keys, "l_quantity", by).agg(F.sum("l_quantity").cast("double").alias("y"))


def x2_entries(spark: SparkSession, sf_dir: str, three_mode: bool = False, by: int = 1) -> DataFrame:
    """Entries of X2, dealt as those of X1."""
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("i0"), F.col("l_partkey").alias("i1")]
    if three_mode:
        keys.append((F.month("l_shipdate") - 1).cast("long").alias("i2"))
    return _by_cell(li, keys, "l_extendedprice", by).agg((F.max("l_extendedprice") / F.lit(1000.0)).alias("y"))


def x3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_partkey").alias("i0"), (F.month("l_shipdate") - 1).cast("long").alias("i1")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("y"))


def holdout(entries: DataFrame) -> DataFrame:
    """Boolean column: the cell belongs to the validation part."""
    return F.pmod(F.col("i0") * F.lit(7) + F.col("i1") * F.lit(13), F.lit(10)) == F.lit(0)


def split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, validation): every cell lands in exactly one part."""
    v = holdout(entries)
    return entries.where(~v), entries.where(v)


def coupled_pair(spark: SparkSession, sf_dir: str, three_mode: bool = False,
                 with_validation: bool = True, materialize: str | None = None):
    """``(tensors, validation tensors or None, couplings)`` for the fit.

    With ``materialize`` (a folder, e.g. under ``spark.checkpoint.dir``) both
    tensors are written once as parquet and the training and validation
    parts are read from there, so the join and aggregation over the fact
    table run once instead of once per part.
    """
    d = dims_of(spark, sf_dir)
    extra = (SHIP_MONTHS,) if three_mode else ()
    dims1 = (d["customer"], d["part"]) + extra
    dims2 = (d["supplier"], d["part"]) + extra
    e1 = x1_entries(spark, sf_dir, three_mode)
    e2 = x2_entries(spark, sf_dir, three_mode)
    if materialize:
        base = materialize.rstrip("/")
        e1.write.mode("overwrite").parquet(f"{base}/x1")
        e2.write.mode("overwrite").parquet(f"{base}/x2")
        e1 = spark.read.schema(e1.schema).parquet(f"{base}/x1")
        e2 = spark.read.schema(e2.schema).parquet(f"{base}/x2")
    coupling = [Coupling(0, 1, 1, 1, 0)]
    if not with_validation:
        return [Tensor(e1, dims1, "x1"), Tensor(e2, dims2, "x2")], None, coupling
    t1, v1 = split(e1)
    t2, v2 = split(e2)
    tensors = [Tensor(t1, dims1, "x1"), Tensor(t2, dims2, "x2")]
    valid = [Tensor(v1, dims1, "x1_valid"), Tensor(v2, dims2, "x2_valid")]
    return tensors, valid, coupling


def coupled_three(spark: SparkSession, sf_dir: str, three_mode: bool = False) -> tuple[list[Tensor], list[Coupling]]:
    """X1, X2 and X3, chained by their part modes at positions 1, 1 and 0 (with ``three_mode`` X1 has three modes, the others two)."""
    d = dims_of(spark, sf_dir)
    tensors = [Tensor(x1_entries(spark, sf_dir, three_mode), (d["customer"], d["part"]) + (SHIP_MONTHS,) * three_mode, "x1"),
               Tensor(x2_entries(spark, sf_dir), (d["supplier"], d["part"]), "x2"),
               Tensor(x3_entries(spark, sf_dir), (d["part"], SHIP_MONTHS), "x3")]
    return tensors, [Coupling(0, 1, 1, 1, 0), Coupling(1, 1, 2, 0, 1)]
