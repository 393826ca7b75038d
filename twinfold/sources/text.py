"""Tab-separated text readers and writers (the reference's only file format).

Tensor lines are ``i_0 \\t ... \\t i_{N-1} \\t value`` with no header; coupling
map lines are ``t_m \\t t_m``. Readers declare the schema (nothing inferred)
and fail on a malformed number or a wrong field count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import entry_columns, index_columns
from twinfold.spec import Coupling, Tensor


def tensor_schema(n_modes: int) -> T.StructType:
    fields = [T.StructField(c, T.LongType(), False) for c in index_columns(n_modes)]
    return T.StructType(fields + [T.StructField("y", T.DoubleType(), False)])


def read_entries(spark: SparkSession, path: str | list[str], n_modes: int) -> DataFrame:
    """Sparse tensor scan (S1): typed ``i0..i{N-1} long, y double`` columns.

    FAILFAST mode makes a malformed number or a short/long line an error at
    the first action, as the reference's ``toInt``/``toDouble`` would.
    """
    return (
        spark.read.schema(tensor_schema(n_modes))
        .option("sep", "\t")
        .option("header", "false")
        .option("mode", "FAILFAST")
        .option("enforceSchema", "true")
        .csv(path)
    )


def read_tensor(spark: SparkSession, path: str | list[str], dims: tuple[int, ...], name: str = "") -> Tensor:
    return Tensor(read_entries(spark, path, len(dims)), tuple(int(d) for d in dims), name)


def read_validation(spark: SparkSession, paths: list[str | None], dims: list[tuple[int, ...]]) -> list[Tensor]:
    """Validation tensor scan (S2): same format; every tensor needs a path."""
    if len(paths) != len(dims):
        raise ValueError("one validation path per tensor")
    if any(not p for p in paths):
        raise ValueError("every tensor needs a validation path")
    return [read_tensor(spark, p, d, f"validation_{i}") for i, (p, d) in enumerate(zip(paths, dims))]


def read_coupling(spark: SparkSession, path: str) -> DataFrame:
    """Coupling map scan (S3): ``(pair int, t1 int, m1 int, t2 int, m2 int)``.

    The pair number is the line number. A map file has one line per coupled
    pair of tensors, so it is read as a single small partition.
    """
    raw = (
        spark.read.schema("left string, right string")
        .option("sep", "\t")
        .option("mode", "FAILFAST")
        .csv(path)
        .coalesce(1)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    a = F.split(F.col("left"), "_")
    b = F.split(F.col("right"), "_")
    return raw.select(
        (F.row_number().over(Window.orderBy("_pos")) - 1).cast("int").alias("pair"),
        a[0].cast("int").alias("t1"),
        a[1].cast("int").alias("m1"),
        b[0].cast("int").alias("t2"),
        b[1].cast("int").alias("m2"),
    )


def coupling_lookup(coupling: DataFrame) -> DataFrame:
    """Both directions of every pair (P2): ``(pair, t, m, partner_t, partner_m)``."""
    fwd = coupling.select("pair", F.col("t1").alias("t"), F.col("m1").alias("m"),
                          F.col("t2").alias("partner_t"), F.col("m2").alias("partner_m"))
    rev = coupling.select("pair", F.col("t2").alias("t"), F.col("m2").alias("m"),
                          F.col("t1").alias("partner_t"), F.col("m1").alias("partner_m"))
    return fwd.unionByName(rev)


def collect_couplings(coupling: DataFrame) -> list[Coupling]:
    """Bring the coupling rows (one per coupled pair of modes) to the driver to plan the sweep."""
    return [Coupling(r.t1, r.m1, r.t2, r.m2, r.pair) for r in coupling.orderBy("pair").collect()]


def write_entries(df: DataFrame, path: str, n_modes: int, mode: str = "overwrite") -> None:
    """Write entries in the tab format the readers accept."""
    cols = entry_columns(n_modes)
    (df.select(*cols).write.mode(mode).option("sep", "\t").option("header", "false").csv(path))
