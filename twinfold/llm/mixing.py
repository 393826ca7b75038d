"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets. Sources weigh 3, 1, 2, repeating, in code point order (null last) and share ``share`` times the size of all
documents. A target stops at ``max_epochs`` times its source's size and the excess goes to the others by weight: the
level at which the targets add up is found from the sources sorted by cap over weight.

Selection. A source takes whole epochs first: floor(target / size) copies of every document. The rest of the
target is a weighted sample without replacement: every document draws the exponential key -ln(u) / weight (u from
its doc_id, weight from its text's quality), documents are taken by rising key until their sizes reach the rest, and
the document on the edge gives only the words that are still missing.

Scale. Keys are laid on a grid that keeps their order. Sizes are summed per source and grid cell (combined before the
shuffle), the cell in which a source's budget ends follows from a running sum over cells, and only the documents of
that one cell are put in exact order. What every document needs to know is then one row per source, so texts are
never shuffled and a source of any size is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.llm.storage import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"
_ROWS_PER_CELL = 2000
_MIN_CELLS = 1024
#: Key at which half of the grid is used up; good documents' keys have mean 1, the worst ones' mean 20.
_MIDDLE = 3.0


def text_quality(text: Column, size: Column) -> Column:
    """Weight from 0.05 to 1: one minus the symbols per word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit("[|#$%&*!]")), F.lit(0))
    return F.greatest(F.lit(0.05), F.lit(1.0) - symbols.cast("double") / F.greatest(size, F.lit(1)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1) from the doc_id (null is a value like any other)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality) -> DataFrame:
    """``docs`` as one struct column ``row`` beside ``source, size, key, id, tie``."""
    sized = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.{source_col}").cast("string").alias("source"), F.col(f"row.{id_col}").alias("id"),
        F.col(f"row.{text_col}").cast("string").alias("body")).withColumn("size", word_count(F.col("body")))
    key = -F.ln(_draw(F.col("id"), seed)) / quality(F.col("body"), F.col("size"))
    return sized.select("row", "source", "size", key.alias("key"), "id", F.xxhash64("body").alias("tie"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (total * share - before) / left)
    full = F.col("cap") / F.col("weight") <= F.col("level")
    final = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    return (level.withColumn("final", final)
            .select("source", "source_size",
                    F.when(F.col("final").isNull(), F.col("cap").cast("double"))
                    .otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))).alias("target")))


def _edges(spark: SparkSession, narrow: DataFrame, goals: DataFrame, cells: int) -> DataFrame:
    """Per source: epochs, and where the fractional selection ends (key, id, tie of the document on the edge, the words
    each of its ``n`` equal rows gives); the key is null if it takes nothing or everything."""
    cell = F.least(F.floor(F.col("key") / (F.col("key") + _MIDDLE) * cells), F.lit(cells - 1)).cast("long")
    placed = narrow.withColumn("cell", cell)
    per_cell = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("cell")
    budget = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(0).cast("long"))
    budget = budget.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    ends = (per_cell.withColumn("upto", F.sum("words").over(run))
            .join(budget.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .where("rest > 0 AND upto >= rest AND upto - words < rest")
            .select("source", "cell", "rest", (F.col("upto") - F.col("words")).alias("before")))
    ends = cut(spark, ends, "cells")
    inside = (placed.join(ends.withColumnRenamed("source", "s").withColumnRenamed("cell", "c"),
                          F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
              .groupBy("source", "key", "id", "tie").agg(F.sum("size").alias("words"), F.count("*").alias("n"),
                                                         F.first("rest").alias("rest"), F.first("before").alias("before")))
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last(), "tie")
    edge = (inside.withColumn("upto", F.col("before") + F.sum("words").over(order))
            .where("upto >= rest AND upto - words < rest")
            .select(F.col("source").alias("s"), F.col("key").alias("edge_key"), F.col("id").alias("edge_id"),
                    F.col("tie").alias("edge_tie"), F.floor((F.col("rest") - F.col("upto") + F.col("words")) / F.col("n"))
                    .cast("long").alias("edge_words")))
    return (budget.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        quality=text_quality) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` (words; input columns of these names are replaced).

    Every input row stays; ``taken`` counts a document's words with repeats and is 0 for what the mix leaves out.
    Null and empty texts have size 0. Rows that agree in doc_id and text share what their group takes evenly. A null source is a
    source of its own. An empty table gives an empty result. Reruns agree: nothing is drawn but from doc_ids.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed, quality)
    narrow = cut(spark, keyed.drop("row"), "mix")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    cells = max(_MIN_CELLS, narrow.count() // _ROWS_PER_CELL)
    plan = cut(spark, _edges(spark, narrow, targets(sizes, weights, share, max_epochs), cells), "plan")
    plan = plan.withColumnRenamed("source", "s")
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    same_key = F.col("key") == F.col("edge_key")
    same_id = F.col("id").eqNullSafe(F.col("edge_id"))
    earlier = (F.col("key") < F.col("edge_key")) | same_key & (
        F.coalesce(F.col("id") < F.col("edge_id"), F.col("edge_id").isNull() & F.col("id").isNotNull())
        | same_id & (F.col("tie") < F.col("edge_tie")))
    part = (F.when(F.col("edge_key").isNull(), F.lit(0)).when(earlier, F.col("size"))
            .when(same_key & same_id & (F.col("tie") == F.col("edge_tie")), F.col("edge_words")).otherwise(F.lit(0)))
    own = {"size", "source_size", "target", "taken"}
    plain = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return joined.select(*plain, "size", "source_size", "target",
                         (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


#: The same mix for DuckDB (rows that repeat a doc_id aside).
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(len(regexp_extract_all(text, '[|#$%&*!]')), 0) AS symbols
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE)
                / 281474976710656::DOUBLE)
            / greatest(0.05::DOUBLE, 1::DOUBLE - symbols::DOUBLE / greatest(size, 1)) AS key
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         2 * source_size AS cap
  FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, (SELECT max(level) FROM levels WHERE cap / weight > level) * weight),
                  cap::DOUBLE) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals),
ranked AS (
  SELECT k.*, g.source_size, g.target, g.epochs, round(g.target)::BIGINT - g.epochs * g.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN budgets g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM ranked
"""
