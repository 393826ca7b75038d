"""Stopping rule and best validated iteration over a durable loss log.

The fit decides iteration by iteration; these decide for any log of any number of fits, with window functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.spec import Stop

#: The loss that the first iteration is compared with, as in the fit.
FIRST_LOSS = 1.0e80


def verdicts(log: DataFrame, stop: Stop, by: Sequence[str] = ()) -> DataFrame:
    """``by.., iter, loss, rel, reason, stopped, final``: what the stopping rule says after every iteration.

    ``log``: columns ``by``, ``iter``, ``seconds``, ``loss`` (the total). ``rel`` is the relative decrease (null where it is not
    finite, and after a loss of 0). ``reason`` is ``decrease`` (too small, a rise, or not finite), ``hours``, ``iterations`` or
    null, tried in this order. ``stopped`` marks the first iteration with a reason and all after it. ``final`` is the iteration whose
    factors the fit returns if it ends here: this one if its loss fell (or it is the first), else the one before.
    """
    each = Window.partitionBy(*by).orderBy("iter")
    before = F.coalesce(F.lag("loss").over(each), F.lit(FIRST_LOSS))
    rel = F.when(before != 0, (before - F.col("loss")) / before)
    rel = F.when(~F.isnan(rel) & (F.abs(rel) < F.lit(float("inf"))), rel)
    reason = F.lit(None).cast("string")
    if stop.max_iter:
        reason = F.when(F.col("iter") >= stop.max_iter, "iterations")
    if stop.max_hours:
        reason = F.when(F.col("seconds") / 3600 > stop.max_hours, "hours").otherwise(reason)
    if stop.min_rel_decrease:
        reason = F.when(F.coalesce(F.col("rel") < stop.min_rel_decrease, F.lit(True)), "decrease").otherwise(reason)
    rated = log.withColumn("rel", rel).withColumn("reason", reason)
    upto = each.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.coalesce(F.lag("iter").over(each), F.col("iter"))
    return rated.select(*by, "iter", "loss", "rel", "reason", (F.count("reason").over(upto) > 0).alias("stopped"),
                        F.when(F.col("rel") > 0, F.col("iter")).otherwise(last).alias("final"))


def best_iterations(log: DataFrame, by: Sequence[str] = (), value: str = "loss") -> DataFrame:
    """``by.., iter, value, best, lag``: after every iteration, the iteration of least ``value`` so far (the first of equals)
    and how many iterations ago it was. A value that is null or NaN is never the best."""
    upto = Window.partitionBy(*by).orderBy("iter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(value).alias("v"), F.col("iter").alias("i")))
    best = F.min(usable).over(upto)["i"]
    return log.select(*by, "iter", value, best.alias("best"), (F.col("iter") - best).alias("lag"))
