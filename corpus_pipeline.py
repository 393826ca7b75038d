"""From raw documents to a training mix: five stages, each written as Parquet and read back by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of the
documents they were given. A document leaves at the quality classifier if its score is below the threshold, loses lines at the line
deduplication, leaves at the near-duplicate stage unless it is the first of its group, leaves at
decontamination if it holds a benchmark window, and the mix returns what it takes, with the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontaminate, line_crf, line_dedup, mixing, simhash
from twinfold.llm.storage import broadcast_if_small, cut, number_rows

MAX_BROADCAST = 1_000_000


_READ = ("doc_id", "text", "source")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage reads out of the way of the operators' own names."""
    return docs.toDF(*[c if c in _READ else f"carried_{i}" for i, c in enumerate(docs.columns)])


def _as(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order and by their names."""
    return out.select(*[F.col(c if c in _READ else f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line-CRF score reaches the threshold (trained on the labelled documents that are not held out)."""
    model = line_crf.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as(line_crf.score_documents(_plain(docs), model).where(F.col("score") >= line_crf.THRESHOLD), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats up to one word; ``n_chars`` follows the text."""
    shorter = _as(line_dedup.dedup_lines(spark, _plain(docs)), docs)
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return shorter


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group that SimHash links connect."""
    numbered = number_rows(spark, _plain(docs))
    found = simhash.near_duplicates(spark, numbered.select("row_id", "text"), "row_id")
    others = cut(spark, found.where("component_id <> doc_id").select(F.col("doc_id").alias("row_id")), "others")
    return _as(numbered.join(broadcast_if_small(others, MAX_BROADCAST), "row_id", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as(decontaminate.contamination(spark, _plain(docs), items).where(F.size("hit_spans") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes words of, with ``size, source_size, target, taken``."""
    return mixing.mix(spark, docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
]

#: The classifier is not a SQL query; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
