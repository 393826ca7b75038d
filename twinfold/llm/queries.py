"""Registered queries of the training-text operators: ``op<N>_<name>`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import (decontaminate, embedding_pq, line_crf, line_dedup, mixing, oracle, pii, secrets, simhash,
                          suffix_dedup, token_pairs, turn_trie, url_templates, winnow)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: its rule's, else that of its host's path template."""
    return url_templates.judge_urls(spark, _table(spark, sf_dir, "pages").select("page_id", "url"))


#: Fixed so that reruns agree; a real run passes its own secret.
PSEUDONYM_KEY = "example key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised, and how many values of each kind were replaced."""
    found = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", "text", *[count(kind).alias(f"n_{kind}") for kind in pii.PATTERNS])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, at most 4 differing bits)."""
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    return decontaminate.digest(decontaminate.contamination(
        spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every byte under a 200-byte string that starts anywhere else."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and inferred formats."""
    return secrets.digest(secrets.find_secrets(spark, _table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = line_crf.train(spark, docs, _table(spark, sf_dir, "labels"))
    return line_crf.score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of lines that repeat an earlier line up to one edited word."""
    found = line_dedup.dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text, with their likeness."""
    return winnow.edited_neighbours(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of the sources to their target weights takes."""
    return (mixing.mix(spark, _table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def op11_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document, scored by corpus-wide counts of linked ids."""
    found, _ = token_pairs.alignment(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with one label at a cosine of 0.98 or more."""
    return embedding_pq.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations with subtree totals."""
    return turn_trie.trie(spark, _table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secrets": op6_secrets,
    "op7_line_crf": op7_line_crf,
    "op8_line_dedup": op8_line_dedup,
    "op9_winnowing": op9_winnowing,
    "op10_mixing": op10_mixing,
    "op11_token_pairs": op11_token_pairs,
    "op12_embedding_pq": op12_embedding_pq,
    "op13_turn_trie": op13_turn_trie,
}

SQL: dict[str, str] = oracle.SQL
