"""Connected components of a link table by alternating star contractions.

Large-star points every larger neighbour of a node at the smallest node it knows,
small-star does the same for the smaller neighbours. Both are one ``min`` per node
(combined before the shuffle) and one join, so a node with very many links is never
gathered in one place. The number of rounds grows with the logarithm of the longest
path; every round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.storage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # After large-star every edge runs from a larger u to a smaller v.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return (moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` (longs) for every node of ``links(u, v)`` that is not its own root.

    ``root`` is the smallest node reachable. Repeated, reversed and self links are allowed; an empty
    link table gives an empty result. Nodes without links do not appear.
    """
    edges = (links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .where("u <> v").distinct())
    edges = cut(spark, edges, "links")
    seen = None
    for _ in range(max_rounds):
        edges = cut(spark, _small_star(_large_star(edges)), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")),
                                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
