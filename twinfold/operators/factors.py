"""Factor tables: ``(idx long, v array<double>)``, one row per index of a mode.

A factor holds every index of its mode's domain, observed or not, so column
means (A8) run over the whole domain as in the reference.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.init import init_value
from twinfold.session import fits_broadcast, splits_hot_keys

#: Bytes of a factor's rows that a task may hash, and of a hashed row beside its doubles (key, headers, pointers).
HASHED_BYTES = 48 << 20
HASHED_ROW = 112
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"

def init_factor(spark: SparkSession, dim: int, rank: int, method: str = "random", tensor: int = 0,
                mode: int = 0, seed: int = 0, value: float = 1.0, diag_rows: int | None = None,
                partitions: int | None = None, domain: DataFrame | None = None) -> DataFrame:
    """Factor init (M1, M2): one row per index with one computed value per cell.

    Indices are ``0 .. dim - 1``, or those of ``domain`` (a table of distinct ``idx``).
    """
    if domain is not None:
        ids = domain.select(F.col("idx").cast("long").alias("id"))
    else:
        ids = spark.range(0, int(dim), 1, partitions) if partitions else spark.range(0, int(dim))
    idx = F.col("id")
    cells = [init_value(method, idx, c, tensor, mode, seed, value, diag_rows) for c in range(rank)]
    return ids.select(idx.alias("idx"), F.array(*cells).alias("v"))


def copy_factor(src: DataFrame, tensor: int, mode: int) -> DataFrame:
    """Factor copy (M3): the source rows relabelled as (tensor, mode)."""
    return src.select(F.lit(tensor).alias("tensor"), F.lit(mode).alias("mode"), "idx", "v")


def column_means(factor: DataFrame, rank: int) -> DataFrame:
    """Column means over all rows (A8): one row ``m_0 .. m_{rank-1}``."""
    return factor.agg(*[F.avg(F.col("v")[c]).alias(f"m_{c}") for c in range(rank)])


def means_rows(factors: Mapping[tuple[int, int], DataFrame], rank: int) -> DataFrame | None:
    """Column means of many factors as rows ``(tensor, mode, col, mean)``, one union job."""
    parts = []
    for (t, m), f in factors.items():
        agg = f.agg(F.array(*[F.avg(F.col("v")[c]) for c in range(rank)]).alias("means"))
        parts.append(agg.select(F.lit(t).alias("tensor"), F.lit(m).alias("mode"),
                                F.posexplode("means").alias("col", "mean")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heavy_indices(entries: DataFrame, mode: int, rows: int | None = None, bins: int | None = None) -> DataFrame:
    """``idx, salts``: indices of ``mode`` with more than ``rows`` entries, and over how many salts to spread each.

    At most entries / rows indices are heavy. By default ``rows`` is the mean number of entries of a shuffle partition, so
    that a salt is no larger than a partition and there are at most as many heavy indices as shuffle partitions: a bound on
    the list, which is broadcast.

    With ``bins`` the entries are read twice, but next to nothing is shuffled: they are counted in so many hash bins of the
    index first, and only indices in a bin of more than ``rows`` entries are counted themselves. No other can be heavy.
    """
    if rows is None:
        parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = max(1, -(-entries.count() // parts))
    if bins:
        hashed = entries.withColumn("_bin", F.pmod(F.xxhash64(f"i{mode}"), F.lit(int(bins))).cast("int"))
        full = hashed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("_bin")
        entries = hashed.join(F.broadcast(full), "_bin", "left_semi")
    return (entries.groupBy(F.col(f"i{mode}").alias("idx")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
            .select("idx", F.ceil(F.col("n") / F.lit(rows)).cast("int").alias("salts")))


def none_heavy(heavy: DataFrame) -> bool:
    """True when the plan of ``heavy`` itself says that it has no rows (:func:`heavy_table` of none); takes no job."""
    most = heavy._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and int(most.get()) == 0


def salt(entries: DataFrame, mode: int, n_modes: int, heavy: DataFrame, name: str = "_salt") -> DataFrame:
    """``entries`` with a salt: a hash of the other indices modulo the salts of the entry's index on ``mode``."""
    h = heavy.select(F.col("idx").alias("_heavy"), F.col("salts").alias("_salts"))
    others = [F.col(f"i{k}") for k in range(n_modes) if k != mode]
    out = entries.join(F.broadcast(h), entries[f"i{mode}"] == h["_heavy"], "left")
    return out.withColumn(name, F.pmod(F.xxhash64(*others), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_heavy", "_salts")


def stored_salt(mode: int) -> str:
    """Column of the salt by which entries are bucketed together with their index on ``mode`` (see :func:`store_entries`)."""
    return f"_salt{mode}"


def dealt_salt(mode: int) -> str:
    """:func:`stored_salt` of entries that are bucketed and not sorted."""
    return f"_dealt{mode}"


def salt_of(entries: DataFrame, mode: int) -> str | None:
    """The salt by which ``entries`` are bucketed together with their index on ``mode``, None if they are not."""
    return next((c for c in (stored_salt(mode), dealt_salt(mode)) if c in entries.columns), None)


def buckets_for_hashing(dim: int, width: int) -> int:
    """Least number of buckets of which each holds at most ``HASHED_BYTES`` of a factor's rows, on average.

    The indices are distinct, so the buckets hold about as many rows each, and the few that salts repeat.
    """
    return max(1, -(-int(dim) * (8 * int(width) + HASHED_ROW) // HASHED_BYTES))


def store_entries(spark: SparkSession, entries: DataFrame, mode: int, n_modes: int, heavy: DataFrame, buckets: int,
                  table: str, path: str, sort: bool = True) -> DataFrame:
    """Entries written once, bucketed and sorted on (index of ``mode``, salt) as ``table`` at ``path``.

    Every later join with the factor of ``mode`` moves the factor's rows only: the entries lie in the buckets the join asks
    for. ``heavy`` must be the list that the joins use. Without ``sort`` the entries are sorted neither here nor in the joins:
    those hash the factor's rows of a bucket, so there must be :func:`buckets_for_hashing` at least.
    """
    keys = [f"i{mode}", stored_salt(mode) if sort else dealt_salt(mode)]
    salted = salt(entries, mode, n_modes, heavy, keys[1]).repartition(buckets, *keys)
    writer = salted.write.bucketBy(buckets, *keys).option("path", path)
    if sort:
        writer.sortBy(*keys).saveAsTable(table)
        return spark.table(table)
    # A task has the rows of one bucket, so one open file: Spark need not sort them by bucket first (and does from a second one on).
    old = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, "2")
    try:
        writer.saveAsTable(table)
    finally:
        spark.conf.set(OPEN_FILES, old)
    return spark.table(table)


def stored_table(spark: SparkSession, mode: int, n_modes: int, buckets: int, table: str, path: str) -> DataFrame:
    """Entries that :func:`store_entries` left unsorted at ``path``, as ``table`` again."""
    columns = ", ".join([*[f"i{k} BIGINT" for k in range(n_modes)], "y DOUBLE", f"{dealt_salt(mode)} INT"])
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (i{mode}, {dealt_salt(mode)}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def heavy_table(spark: SparkSession, rows: Sequence[tuple[int, int]]) -> DataFrame:
    """``idx, salts`` of a collected list of heavy indices (:func:`heavy_indices` bounds it)."""
    if not rows:
        return spark.sql("SELECT * FROM VALUES (0L, 1) AS t(idx, salts) WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({int(i)}L, {int(s)})' for i, s in rows)} AS t(idx, salts)")


def join_salted(entries: DataFrame, factor: DataFrame, mode: int, salt_col: str, heavy: DataFrame) -> DataFrame:
    """Left join of ``f{mode}`` on (index, salt), the factor's rows repeated for each salt of a heavy index.

    The hint keeps Spark from broadcasting a factor that is over the bound by its estimates. Entries bucketed and not sorted meet
    a hash table of the factor's rows of their bucket, others are sorted and merged with them.
    """
    how = "shuffle_hash" if salt_col == dealt_salt(mode) else "merge"
    few = heavy.select(F.col("idx").alias("_heavy"), "salts")
    f = factor.select(F.col("idx").alias("_k"), F.col("v").alias(f"f{mode}"))
    f = f.join(F.broadcast(few), F.col("_k") == F.col("_heavy"), "left").select(
        "_k", f"f{mode}", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("_s")).hint(how)
    return entries.join(f, (entries[f"i{mode}"] == f["_k"]) & (entries[salt_col] == f["_s"]), "left").drop("_k", "_s")


def join_sorted(entries: DataFrame, factor: DataFrame, mode: int) -> DataFrame:
    """Left join of ``f{mode}`` on the index, sort-merge: AQE splits the partitions of hot indices.

    Entries that lie by this index already stay where they are.
    """
    f = factor.select(F.col("idx").alias("_k"), F.col("v").alias(f"f{mode}")).hint("merge")
    return entries.join(f, entries[f"i{mode}"] == f["_k"], "left").drop("_k")


def hot_list(entries: DataFrame, mode: int, heavy: Mapping[int, DataFrame] | None) -> DataFrame | None:
    """The heavy indices of ``mode`` to salt by: those handed in, or measured where AQE does not split them (None: it does).

    Measuring reads all entries, so entries that are not kept anywhere would be built again for every list.
    """
    if heavy and mode in heavy:
        return heavy[mode]
    return None if splits_hot_keys(entries.sparkSession) else heavy_indices(entries, mode)


def sound(joined: DataFrame, mode: int, width: int) -> DataFrame:
    """``joined`` with ``f{mode}`` checked: an entry without a factor row, or whose row has a null, NaN or infinite cell, fails."""
    total = " + ".join(f"f{mode}[{r}]" for r in range(width))
    return joined.withColumn(f"f{mode}", F.expr(
            f"CASE WHEN ({total}) * 0D = 0D THEN f{mode} ELSE raise_error(concat("
            f"'no finite factor row for index ', CAST(i{mode} AS STRING), ' of mode {mode}')) END"))


def join_factors(spark: SparkSession, entries: DataFrame, factors: Mapping[int, DataFrame],
                 dims: Sequence[int], modes: Iterable[int], width: int,
                 heavy: Mapping[int, DataFrame] | None = None) -> DataFrame:
    """Entry x factor lookup (J1): add ``f{m}`` (the row of mode m) for each mode.

    Many-to-one left joins on ``i{m} = idx``: no entry is ever dropped, and one whose index has no finite factor row
    fails the job, naming the index. A factor is broadcast only when its declared row count bounds it below the
    broadcast limit. Otherwise the join is a sort-merge join: on the index where AQE splits hot ones (:func:`hot_list`), on
    ``(index, salt)`` with a list: a heavy index is spread over salts and its factor row repeated for each. Entries bucketed on a mode (:func:`store_entries`) stay where they are for that
    mode's join, which therefore comes first. ``heavy`` may hand in :func:`heavy_indices` per mode where they are known.
    """
    out = entries
    n_modes = len(dims)
    for m in sorted(modes, key=lambda k: salt_of(entries, k) is None):
        if fits_broadcast(spark, dims[m], width):
            f = factors[m].select(F.col("idx").alias(f"_k{m}"), F.col("v").alias(f"f{m}"))
            out = out.join(F.broadcast(f), out[f"i{m}"] == f[f"_k{m}"], "left").drop(f"_k{m}")
        else:
            hot = hot_list(entries, m, heavy)
            if hot is None:
                out = join_sorted(out, factors[m], m)
            elif salt_of(entries, m) is not None:
                out = join_salted(out, factors[m], m, salt_of(entries, m), hot)
            else:
                out = join_salted(salt(out, m, n_modes, hot), factors[m], m, "_salt", hot).drop("_salt")
        out = sound(out, m, width)
    return out


def block_row(old: str, new_cells: Sequence, start: int, end: int, rank: int):
    """``old[0:start] ++ new ++ old[end:rank]`` as one array expression."""
    cells = [F.col(old)[c] for c in range(start)] + list(new_cells) + [F.col(old)[c] for c in range(end, rank)]
    return F.array(*cells)


def upsert_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full-row upsert (J4): rows of ``new (idx, v)`` replace old ones; the rest stay."""
    n = new.select(F.col("idx").alias("_nidx"), F.col("v").alias("_nv"))
    j = old.join(n, old["idx"] == n["_nidx"], "left")
    return j.select("idx", F.coalesce(F.col("_nv"), F.col("v")).alias("v"))


def upsert_block(old: DataFrame, new: DataFrame, start: int, end: int, rank: int) -> DataFrame:
    """Column-block upsert (J5): ``new (idx, x array)`` overwrites columns [start, end)."""
    n = new.select(F.col("idx").alias("_nidx"), F.col("x").alias("_x"))
    j = old.join(n, old["idx"] == n["_nidx"], "left")
    merged = block_row("v", [F.col("_x")[c] for c in range(end - start)], start, end, rank)
    return j.select("idx", F.when(F.col("_nidx").isNotNull(), merged).otherwise(F.col("v")).alias("v"))


def flatten(factor: DataFrame, rank: int, prefix: str = "v") -> DataFrame:
    """``idx, v0 .. v{rank-1}`` - plain columns for export and comparison."""
    return factor.select("idx", *[F.col("v")[c].alias(f"{prefix}{c}") for c in range(rank)])
