"""Operators over tensor entries: keying, checks, counts, slices, coupled slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.columns import index_columns
from twinfold.spec import Tensor


def mode_key(entries: DataFrame, mode: int, n_modes: int) -> DataFrame:
    """Key every entry by its index on ``mode`` (P1): ``key, i0..i{N-1}, y``."""
    return entries.select(F.col(f"i{mode}").alias("key"), *index_columns(n_modes), "y")


def count_entries(tensor: Tensor, by: Sequence[str] = ()) -> DataFrame:
    """Entry count (A1) as a one-row DataFrame ``n``, or one row per value of the columns ``by``."""
    return tensor.entries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def group_by_mode(tensor: Tensor, mode: int, page: int = 10_000) -> DataFrame:
    """Slices of a mode (A2) in pages: ``key, page, n, entries array<struct<i0..,y>>``.

    A slice of n entries becomes ``ceil(n / page)`` pages over which its entries are spread by a hash of their
    coordinates and value, so a hot key never sits in one row (only copies of one entry always share a page). For inspection
    and export; the fit aggregates normal equations with partial sums instead.
    """
    cols = index_columns(tensor.n_modes) + ["y"]
    key = F.col(f"i{mode}")
    pages = tensor.entries.groupBy(key.alias("key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(int(page))).cast("int").alias("_pages"))
    entries = tensor.entries.select(key.alias("key"), F.struct(*cols).alias("entry"))
    at = F.pmod(F.xxhash64("entry"), F.col("_pages")).cast("int")
    return (entries.join(pages, "key").groupBy("key", at.alias("page"))
            .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("entry")).alias("entries")))


def slice_sizes(tensor: Tensor, mode: int) -> DataFrame:
    """Per-key summary of a mode slice: ``key, n, sum_y`` (partial aggregation)."""
    return tensor.entries.groupBy(F.col(f"i{mode}").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y")
    )


def coupled_slices(a: Tensor, mode_a: int, b: Tensor, mode_b: int) -> DataFrame:
    """Coupled slice join (J2): keys seen in both tensors, ``key, n_a, n_b``.

    Inner join of the two per-key summaries, so only one row per key moves
    through the join; keys seen on one side only are dropped.
    """
    sa = slice_sizes(a, mode_a).select("key", F.col("n").alias("n_a"))
    sb = slice_sizes(b, mode_b).select("key", F.col("n").alias("n_b"))
    return sa.join(sb, "key", "inner")


def coupled_entries(a: Tensor, mode_a: int, b: Tensor, mode_b: int, page: int = 10_000) -> DataFrame:
    """Coupled slices with their entries (J2): ``key, page, entries_a, entries_b`` for keys seen in both tensors.

    Both slices of a key come in pages (:func:`group_by_mode`), and page p of one side meets page p of the other: a key has
    as many rows as its longer slice has pages, every entry is in one of them, and no row holds more than about ``page``
    entries of a side, however hot the key. Where a side has no page of that number its list is empty.
    """
    keys = coupled_slices(a, mode_a, b, mode_b).select("key")
    left = group_by_mode(a, mode_a, page).select("key", "page", F.col("entries").alias("entries_a"))
    right = group_by_mode(b, mode_b, page).select("key", "page", F.col("entries").alias("entries_b"))
    both = left.join(right, ["key", "page"], "full").join(keys, "key", "left_semi")
    empty = F.array()
    return both.select("key", "page", F.coalesce("entries_a", empty.cast(left.schema["entries_a"].dataType)).alias("entries_a"),
                       F.coalesce("entries_b", empty.cast(right.schema["entries_b"].dataType)).alias("entries_b"))


def validate(tensor: Tensor, max_broadcast: int = 1_000_000) -> DataFrame:
    """Rows that break the data model (P8): ``i0.., y, issue``.

    Issues: ``null_index``, ``out_of_range`` (index outside ``[0, dim)``),
    ``bad_value`` (null, NaN or infinite y), ``duplicate`` (coordinate seen
    more than once; each copy is reported, duplicates are still legal input; coordinates with a null are not compared).

    Duplicates are found by counting 64-bit hashes of the coordinates, combined before the one narrow shuffle, so a
    coordinate with any number of copies is one row per task. Only entries whose hash occurs twice are looked at again: they are
    picked by a broadcast of those hashes (at most ``max_broadcast``; beyond, by a shuffle join that splits hot hashes), and
    their coordinates are counted exactly.
    """
    idx = index_columns(tensor.n_modes)
    e = tensor.entries
    null_idx = F.lit(False)
    out = F.lit(False)
    for c, d in zip(idx, tensor.dims):
        null_idx = null_idx | F.col(c).isNull()
        out = out | (F.col(c) < F.lit(0)) | (F.col(c) >= F.lit(int(d)))
    bad_y = F.col("y").isNull() | F.isnan("y") | (F.abs(F.col("y")) == F.lit(float("inf")))
    row_issue = (
        F.when(null_idx, F.lit("null_index"))
        .when(out, F.lit("out_of_range"))
        .when(bad_y, F.lit("bad_value"))
    )
    flagged = e.select(*idx, "y", row_issue.alias("issue")).where(F.col("issue").isNotNull())

    def few(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.limit(max_broadcast + 1).count() <= max_broadcast else table

    hashed = e.where(~null_idx).select(*idx, "y", F.xxhash64(*idx).alias("_hash"))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    suspects = hashed.join(few(again), "_hash", "left_semi")
    dup_keys = suspects.groupBy(*idx).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").select(*idx)
    dups = suspects.join(few(dup_keys), idx, "left_semi").select(*idx, "y", F.lit("duplicate").alias("issue"))
    return flagged.unionByName(dups)


def check(tensor: Tensor, allow_duplicates: bool = True) -> int:
    """Raise on any row that breaks the data model (one aggregate job); returns the entry count."""
    return check_and_sum(tensor, allow_duplicates)[0]


def check_and_sum(tensor: Tensor, allow_duplicates: bool = True) -> tuple[int, float]:
    """:func:`check` that also returns the sum of the squared values, from the same job."""
    return check_and_digest(tensor, allow_duplicates)[:2]


def check_and_digest(tensor: Tensor, allow_duplicates: bool = True) -> tuple[int, float, str]:
    """:func:`check_and_sum` that also returns a digest of the entries, from the same job.

    The digest sums a 64-bit hash of every entry, whatever their order: tensors of other entries differ in it. The hash is
    summed in three pieces, so that no sum overflows.
    """
    idx = index_columns(tensor.n_modes)
    conds = []
    for c, d in zip(idx, tensor.dims):
        conds.append(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= int(d)))
    bad_idx = conds[0]
    for c in conds[1:]:
        bad_idx = bad_idx | c
    bad_y = F.col("y").isNull() | F.isnan("y") | (F.abs(F.col("y")) == F.lit(float("inf")))
    _hash = f"xxhash64({', '.join(idx)}, y)"
    row = tensor.entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(bad_idx, 1).otherwise(0)).alias("bad_idx"),
        F.sum(F.when(bad_y, 1).otherwise(0)).alias("bad_y"),
        F.sum(F.col("y") * F.col("y")).alias("squares"),
        *[F.sum(F.expr(f"shiftright({_hash}, {low}) & {(1 << width) - 1}L")).alias(f"hash_{low}") for low, width in ((0, 21), (21, 21), (42, 22))],
    ).collect()[0]
    if row.bad_idx:
        raise ValueError(f"tensor {tensor.name}: {row.bad_idx} entries have an index outside {tensor.dims}")
    if row.bad_y:
        raise ValueError(f"tensor {tensor.name}: {row.bad_y} entries have a null, NaN or infinite value")
    if not allow_duplicates:
        dup = tensor.entries.groupBy(*idx).count().where("count > 1").limit(1).count()
        if dup:
            raise ValueError(f"tensor {tensor.name} has duplicate coordinates")
    return int(row.n), float(row.squares or 0.0), "_".join(str(row[f"hash_{low}"] or 0) for low in (0, 21, 42))


def partitions_for(spark, n_entries: int, n_modes: int, partition_bytes: int, split: int | None = None,
                   dim: int | None = None) -> int:
    """Partition count for cached entries of one mode.

    With ``split``, as many partitions as the reference's job gives a mode: ``min(split, dim)``. Without, enough for
    the cores and for at most ``partition_bytes`` of raw entries (8 bytes per index and value) each.
    """
    if split is not None:
        return max(1, min(int(split), int(dim) if dim is not None else int(split)))
    by_size = -(-int(n_entries) * 8 * (n_modes + 1) // max(int(partition_bytes), 1))
    return max(spark.sparkContext.defaultParallelism, by_size, 1)


def cluster_by_mode(entries: DataFrame, mode: int, n_modes: int, partitions: int) -> DataFrame:
    """Entries range-partitioned on ``(i{mode}, other indices)``.

    Each partition holds a contiguous run of keys of ``mode``, so the
    partial aggregate of that mode's normal equations emits about one row
    per key instead of one per entry, and the shuffle after it carries
    little. The other indices break ties in the range bounds, so a key that
    holds a third of all entries is spread over many partitions instead of
    landing in one.
    """
    order = [f"i{mode}"] + [f"i{k}" for k in range(n_modes) if k != mode]
    return entries.repartitionByRange(int(partitions), *order)
