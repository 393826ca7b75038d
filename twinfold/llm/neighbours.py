"""Every document together with the next one in descending doc_id order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _part(bounds: list[int], column: str) -> str:
    """SQL for the number of bounds at or below ``column``: a balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {column} < {bounds[mid]}L THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return tree(0, len(bounds))


def with_next(docs: DataFrame, id_col: str, text_col: str, stretch: Callable[[list[str], list], pa.RecordBatch],
              schema: T.StructType, chunk_bytes: int) -> DataFrame:
    """Rows that ``stretch(texts, ids)`` makes of runs of neighbours (it answers for all but the last row of a run).

    Documents are dealt by doc_id range (bounds from quantiles of the ids) and sorted within a range; the text
    moves once. The first document of each range is copied to the range above it, and the very first to the
    lowest range, so that the last document of every range finds its next. Null texts are empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    bounds = sorted({int(c) for c in cuts})
    placed = rows.withColumn("part", F.expr(f"CASE WHEN doc_id IS NULL THEN 0 ELSE {_part(bounds, 'doc_id')} END"))
    tops = sorted((r.part, r.top) for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], schema)
    # One row per range: its first document's id, the range above it, and (for the last range) the lowest one.
    guide = spark.createDataFrame(
        [(part, top, tops[i + 1][0] if i + 1 < len(tops) else None, tops[0][0] if i + 1 == len(tops) else None)
         for i, (part, top) in enumerate(tops)], "part int, top long, above int, lowest int")
    placed = placed.join(F.broadcast(guide), "part")
    first = F.col("doc_id").eqNullSafe(F.col("top"))
    homes = F.filter(F.array(
        F.struct(F.col("part").alias("part"), F.lit(0).alias("kind")),
        F.struct(F.when(first, F.col("above")).alias("part"), F.lit(1).alias("kind")),
        F.struct(F.when(first, F.col("lowest")).alias("part"), F.lit(2).alias("kind"))), lambda h: h["part"].isNotNull())
    dealt = (placed.withColumn("home", F.explode(homes))
             .select(F.col("home.part").alias("part"), F.col("home.kind").alias("kind"), "doc_id", "text")
             .repartitionById(len(bounds) + 1, F.col("part"))
             .sortWithinPartitions("part", "kind", F.col("doc_id").desc_nulls_last(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ids: list = []
        here, size, guests = None, 0, False
        for batch in batches:
            part, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if part[i] != here or kind[i]:
                    # The first guest after a range's own rows ends it; later guests are further ties.
                    if part[i] == here and not guests:
                        texts.append(batch.column(3)[i].as_py())
                        ids.append(None)
                        guests = True
                    if len(texts) > 1:
                        yield stretch(texts, ids)
                    texts, ids, size = [], [], 0
                    if part[i] != here:
                        here, guests = part[i], False
                    if kind[i]:
                        continue
                texts.append(batch.column(3)[i].as_py())
                ids.append(batch.column(2)[i].as_py())
                size += len(texts[-1])
                if size >= chunk_bytes and len(texts) > 1:
                    yield stretch(texts, ids)
                    texts, ids = texts[-1:], ids[-1:]
                    size = len(texts[0])
        if len(texts) > 1:
            yield stretch(texts, ids)

    return dealt.mapInArrow(run, schema)
