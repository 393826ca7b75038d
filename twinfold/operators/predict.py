"""CP prediction, losses and metrics, rescaling of predictions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions.columns import cp_sum, index_columns, vector_columns
from twinfold.operators.factors import join_factors
from twinfold.operators.normal import checked_row, error_of_sums, sums_with_rows
from twinfold.spec import Tensor

# The reference's rescale table for predictions, keyed by the
# mode-1 index. (exclusive upper bound, factor) in order, then the factor for
# every larger index.
REFERENCE_RESCALE_BREAKS = [
    (63, 301894.0), (360, 301895.0), (578, 230410.0), (719, 215337.0),
    (896, 299896.0), (1039, 116771.0), (1153, 301895.0), (1356, 299898.0),
    (1473, 301895.0), (1542, 299897.0), (1852, 301897.0),
]
REFERENCE_RESCALE_ELSE = 100532.0


def predict(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], rank: int,
            keep: Sequence[str] | None = None, heavy: Mapping[int, DataFrame] | None = None) -> DataFrame:
    """CP predict (P4): ``yhat = sum_r prod_m F_m[i_m, r]`` at every entry.

    Returns the index columns, ``y`` when present, and ``yhat``; an entry without finite factor rows fails.
    """
    n = tensor.n_modes
    j = join_factors(spark, tensor.entries, factors, tensor.dims, range(n), rank, heavy)
    cols = list(keep) if keep is not None else [c for c in tensor.entries.columns]
    return j.select(*cols, cp_sum(vector_columns(n), range(rank)).alias("yhat"))


def squared_error(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], rank: int,
                  heavy: Mapping[int, DataFrame] | None = None, sums: tuple[int, DataFrame] | None = None) -> DataFrame:
    """One row ``(sse, n)`` for a tensor (A6 / A7 building block).

    ``sums``: a mode and its sums at the rows of the other modes (``normal.mode_sums``), if known; the error is made of them.
    It is a difference of sums then, with hardly a digit left far below the values' squares.
    """
    if sums is not None:
        mode, table = sums
        error = error_of_sums(0, rank, [f"own_{c}" for c in range(rank)])
        each = sums_with_rows([table], [("own", factors[mode])], rank).selectExpr("n_0 AS n", f"{checked_row('own', rank, error)} AS sse")
        return each.agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    p = predict(spark, tensor, factors, rank, keep=index_columns(tensor.n_modes) + ["y"], heavy=heavy)
    d = F.col("y") - F.col("yhat")
    return p.agg(F.sum(d * d).alias("sse"), F.count(F.lit(1)).alias("n"))


def training_loss(sse: float, n: int, loss: str) -> float:
    """SSE under LS, SSE / entries under WLS."""
    return sse / n if loss == "wls" and n else sse


def rmse(sse: float, n: int) -> float:
    """``sqrt(SSE / entries)`` (the same under LS and WLS)."""
    return math.sqrt(sse / n) if n else float("nan")


def mean_loss(mean_a: Sequence[float], mean_b: Sequence[float], loss: str) -> float:
    """``sum_c (mean_a[c] - mean_b[c])^2``, divided by the rank under WLS."""
    se = sum((a - b) ** 2 for a, b in zip(mean_a, mean_b))
    return se / len(mean_a) if loss == "wls" and len(mean_a) else se


def mean_loss_df(factor_a: DataFrame, factor_b: DataFrame, rank: int, loss: str = "ls") -> DataFrame:
    """A9 as one lazy plan: ``mean_loss`` from the column means of two factors."""
    both = factor_a.select(F.lit(0).alias("_side"), "v").unionByName(
        factor_b.select(F.lit(1).alias("_side"), "v"))
    aggs = []
    for c in range(rank):
        aggs.append(F.avg(F.when(F.col("_side") == 0, F.col("v")[c])).alias(f"a_{c}"))
        aggs.append(F.avg(F.when(F.col("_side") == 1, F.col("v")[c])).alias(f"b_{c}"))
    se: Column = F.lit(0.0)
    for c in range(rank):
        diff = F.col(f"a_{c}") - F.col(f"b_{c}")
        se = se + diff * diff
    if loss == "wls":
        se = se / F.lit(float(rank))
    return both.agg(*aggs).select(se.alias("mean_loss"))


def loss_table(spark: SparkSession, tensors: Sequence[Tensor], factors: Mapping[tuple[int, int], DataFrame],
               rank: int, prefix: str = "train",
               heavy: Sequence[Mapping[int, DataFrame]] | None = None,
               sums: Sequence[tuple[int, DataFrame] | None] | None = None) -> DataFrame:
    """Per-tensor ``(part, tensor, sse, n)`` rows as one union (A10 building block)."""
    out = None
    for t, ten in enumerate(tensors):
        fac = {m: factors[(t, m)] for m in range(ten.n_modes)}
        row = squared_error(spark, ten, fac, rank, heavy[t] if heavy else None, sums[t] if sums else None).select(
            F.lit(prefix).alias("part"), F.lit(t).alias("tensor"), "sse", "n")
        out = row if out is None else out.unionByName(row)
    return out


def denormalise(df: DataFrame, breaks: Sequence[tuple[int, float]], otherwise: float, mode: int = 1,
                value: str = "yhat", out: str | None = None) -> DataFrame:
    """Range rescale (J6): multiply ``value`` by the factor of the range holding ``i{mode}``.

    ``breaks`` are ascending exclusive upper bounds; the first range that
    holds the index wins, as in an if-chain, so the lookup is a CASE
    expression evaluated in codegen rather than a join.
    """
    idx = F.col(f"i{mode}")
    scale = None
    for upper, factor in breaks:
        cond = idx < F.lit(int(upper))
        scale = F.when(cond, F.lit(float(factor))) if scale is None else scale.when(cond, F.lit(float(factor)))
    scale = F.lit(float(otherwise)) if scale is None else scale.otherwise(F.lit(float(otherwise)))
    return df.withColumn(out or value, F.col(value) * scale)


def disjoint_ranges(ranges: DataFrame, dim: int) -> tuple[DataFrame, int, int]:
    """``bin, lo, hi, scale``: ranges over ``[0, dim)`` that do not overlap, cut at the borders of equal bins; the bins' width and number.

    ``ranges``: ``lo`` (inclusive; null: from 0), ``hi`` (exclusive; null: to the end) and ``scale``. Where ranges overlap, the one
    with the smallest ``hi`` holds, as in a chain of ascending upper bounds (then the smallest ``lo``, then the smallest
    scale). Empty ranges and ranges without a scale hold nothing. There are as many bins as ranges; the work is the sum of
    the squares of the ranges in a bin, so little unless most ranges lie in a small part of the domain.
    """
    whole = ranges.select(F.greatest(F.coalesce(F.col("lo").cast("long"), F.lit(0)), F.lit(0)).alias("lo"),
                          F.least(F.coalesce(F.col("hi").cast("long"), F.lit(int(dim))), F.lit(int(dim))).alias("hi"),
                          F.col("scale").cast("double").alias("scale")).where("lo < hi AND scale IS NOT NULL")
    n = max(1, whole.count())
    width = max(1, -(-int(dim) // n))
    spread = whole.select("lo", "hi", "scale", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("bin"))
    spread = spread.selectExpr("*", f"greatest(lo, bin * {width}) AS a", f"least(hi, (bin + 1) * {width}) AS b")
    cuts = spread.select("bin", F.explode(F.array("a", "b")).alias("at")).distinct()
    pieces = cuts.withColumn("next", F.lead("at").over(Window.partitionBy("bin").orderBy("at"))).where("next IS NOT NULL")
    held = pieces.join(spread, "bin").where("a <= at AND at < b").groupBy("bin", "at", "next").agg(
        F.min(F.struct("hi", "lo", "scale")).alias("first"))
    return held.select("bin", F.col("at").alias("lo"), F.col("next").alias("hi"), "first.scale"), width, n


def rescale(df: DataFrame, ranges: DataFrame, dim: int, mode: int = 1, value: str = "yhat", out: str | None = None,
            otherwise: float = 1.0, max_broadcast: int = 100_000) -> DataFrame:
    """Range join (J6): ``value`` times the scale of the range of ``ranges`` that holds ``i{mode}``.

    An index in a gap, outside ``[0, dim)`` or null takes ``otherwise``. Overlaps are settled by :func:`disjoint_ranges`. The join is
    on the bin, so every row compares with the few ranges of its own bin. The ranges are broadcast if there are at most
    ``max_broadcast`` of them in all bins; otherwise both sides are shuffled by bin, and hot bins are split by the
    adaptive skew join.
    """
    flat, width, _ = disjoint_ranges(ranges, dim)
    held = flat.select(F.col("bin").alias("_bin"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("scale").alias("_scale"))
    held = F.broadcast(held) if held.limit(max_broadcast + 1).count() <= max_broadcast else held
    at = F.col(f"i{mode}")
    joined = df.join(held, (F.expr(f"i{mode} div {width}") == F.col("_bin")) & (at >= F.col("_lo")) & (at < F.col("_hi")), "left")
    scaled = joined.withColumn(out or value, F.col(value) * F.coalesce("_scale", F.lit(float(otherwise))))
    return scaled.drop("_bin", "_lo", "_hi", "_scale")
