"""Sinks (S4-S8): factor tables, tab-text exports, metrics and logs, predictions.

Everything is written by Spark tasks to the given (shared) folder; nothing
is collected to the driver. Tab exports keep the reference's layouts: a
factor file has one line per index in index order, ``rank`` values per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.columns import index_columns


def save_factor_table(factors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(tensor, mode, idx, v)`` as parquet partitioned by tensor and mode."""
    factors.write.mode(mode).partitionBy("tensor", "mode").parquet(path)


def factor_lines(factor: DataFrame, rank: int) -> DataFrame:
    """One text line per index: the row's values joined by tabs, ordered by idx."""
    vals = [F.col("v")[c].cast("string") for c in range(rank)]
    return factor.orderBy("idx").select(F.concat_ws("\t", *vals).alias("value"))


def export_factor_text(factor: DataFrame, rank: int, path: str) -> None:
    """S4 tab export of one factor (``U_{t}_{m}`` layout); a global sort keeps line order."""
    factor_lines(factor, rank).write.mode("overwrite").text(path)


def export_model_text(model, path: str, prefix: str = "", paths: dict | None = None) -> None:
    """All factors of a model as ``{path}/{prefix}U_{t}_{m}`` text folders."""
    for (t, m), p in sorted((paths or model.paths).items()):
        f = model.spark.read.parquet(p).select("idx", "v")
        export_factor_text(f, model.rank, f"{path}/{prefix}U_{t}_{m}")


def log_table(metrics: DataFrame, terms: list[str]) -> DataFrame:
    """Metrics pivoted to one row per iteration with the given terms as columns."""
    wide = metrics.groupBy("iter").pivot("term", terms).agg(F.first("loss"))
    secs = metrics.groupBy("iter").agg(F.max("seconds").alias("seconds"))
    return secs.join(wide, "iter").orderBy("iter")


def write_training_log(metrics: DataFrame, n_tensors: int, path: str) -> None:
    """``iter, seconds, se_0.., mean, total`` per iteration as tab text with a header."""
    terms = [f"se_{t}" for t in range(n_tensors)] + ["mean", "total"]
    log = log_table(metrics, terms).select("iter", "seconds", *terms)
    log.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_validation_log(metrics: DataFrame, n_tensors: int, path: str) -> None:
    """``iter, val_rmse_0..`` per iteration as tab text with a header."""
    terms = [f"val_rmse_{t}" for t in range(n_tensors)]
    log = log_table(metrics, terms).select("iter", *terms)
    log.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_predictions(pred: DataFrame, n_modes: int, path: str, value: str = "yhat") -> None:
    """``i0 .. i{N-1} \\t value`` lines, the reference's prediction layout."""
    cols = index_columns(n_modes) + [value]
    pred.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)
