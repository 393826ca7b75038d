"""Observations and keyed normal equations for one block of one mode.

For the row of index ``key`` on mode ``m`` and a block of columns ``B``, each
entry gives one least-squares observation

* design ``a_j = prod_{k != m} F_k[i_k, B_j]`` (P3, a Khatri-Rao row),
* target ``y - sum_{r not in B} prod_k F_k[i_k, r]`` (P5; includes mode m),
* weight ``w`` (P6: 1 under LS, 1/entries under WLS).

The normal equations ``sum w a a^T`` and ``sum w t a`` are plain ``sum``
aggregates per key (A3): Spark plans them as a partial hash aggregate before
the shuffle and a final one after it, so a key holding a third of all entries
is combined on every map task instead of being collected in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.columns import cell_names, cp_sum, rhs_names, row_product
from twinfold.operators.factors import hot_list, join_factors, join_salted, join_sorted, none_heavy, salt, salt_of, sound
from twinfold.session import fits_broadcast
from twinfold.spec import Tensor


def _prod_sql(vectors: Sequence[str], r: int) -> str:
    return " * ".join(f"{v}[{r}]" for v in vectors) if vectors else "CAST(1 AS DOUBLE)"


def observations(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], mode: int,
                 block: Sequence[int], rank: int, with_own: bool | None = None,
                 heavy: Mapping[int, DataFrame] | None = None) -> DataFrame:
    """Design and target per entry (P3, P5): ``key, a_0..a_{k-1}, t``.

    ``block`` lists the columns being solved; the remaining columns of the
    rank form the residual subtracted from ``y``. The factor of ``mode``
    itself is joined only when the residual needs it. Expressions are
    passed as SQL text: one call builds the whole projection.

    When every joined factor is broadcast, the observations keep the
    entries' partitioning (clustered on the key), so the partial aggregate
    that follows combines each key's rows map-side. When a factor is too
    large to broadcast, its join scatters the keys; the observations are then
    brought together on the key, so the following partial aggregate is
    effective again: by a rebalance, whose hot partitions AQE splits, or, with a
    list of heavy indices, on ``(key, salt)`` with as many salts as the key's
    measured entry count asks for (:func:`hot_list`), on the key alone if there is none. Where the factor of ``mode`` is needed and large, its
    own join does that (moving nothing if the entries are stored in
    the buckets of the mode), so a matrix whose entries are stored in
    the buckets of the other mode moves one narrow row per entry, once.
    """
    n = tensor.n_modes
    others = [k for k in range(n) if k != mode]
    rest = [r for r in range(rank) if r not in set(block)]
    own = bool(rest) if with_own is None else with_own
    modes = others + ([mode] if own else [])
    other_vecs = [f"f{k}" for k in others]
    a = [f"{_prod_sql(other_vecs, r)} AS a_{i}" for i, r in enumerate(block)]
    all_vecs = [f"f{k}" for k in modes]
    target = "y - (" + " + ".join(_prod_sql(all_vecs, r) for r in rest) + ")" if rest else "y"
    small = {k: fits_broadcast(spark, tensor.dims[k], rank) for k in modes}
    if all(small.values()):
        j = join_factors(spark, tensor.entries, factors, tensor.dims, modes, rank, heavy)
        return j.selectExpr(f"i{mode} AS key", *a, f"{target} AS t")
    hot = hot_list(tensor.entries, mode, heavy)
    large_own = own and not small[mode]
    j = join_factors(spark, tensor.entries, factors, tensor.dims, others if large_own else modes, rank, heavy)
    if hot is not None and not large_own and none_heavy(hot):
        return j.selectExpr(f"i{mode} AS key", *a, f"{target} AS t").repartition("key")
    stored = salt_of(tensor.entries, mode) if hot is not None else None
    if hot is not None and stored is None:
        j = salt(j, mode, n, hot)
    if large_own:
        j = (join_sorted(j, factors[mode], mode) if hot is None
             else join_salted(j, factors[mode], mode, stored or "_salt", hot))
        return sound(j, mode, rank).selectExpr(f"i{mode} AS key", *a, f"{target} AS t")
    if hot is None:
        return j.selectExpr(f"i{mode} AS key", *a, f"{target} AS t").hint("rebalance", "key")
    return j.selectExpr(f"i{mode} AS key", *a, f"{target} AS t", "_salt").repartition("key", "_salt").drop("_salt")


def normal_equations(obs: DataFrame, k: int, weight: float = 1.0, squares: bool = False) -> DataFrame:
    """Keyed normal-equation aggregate (A3): ``key, n, ata_p_q (p<=q), atb_p`` and, with ``squares``, ``tt``.

    ``weight`` multiplies every observation; it is applied once per key
    after the sums, which is the same algebra with fewer multiplications.
    ``tt`` is the sum of the squared targets, without the weight.
    """
    w = float(weight)
    aggs = [F.count(F.lit(1)).alias("n")]
    for p, q, name in cell_names(k):
        s = F.sum(F.col(f"a_{p}") * F.col(f"a_{q}"))
        aggs.append((s * F.lit(w) if w != 1.0 else s).alias(name))
    for p, name in enumerate(rhs_names(k)):
        s = F.sum(F.col("t") * F.col(f"a_{p}"))
        aggs.append((s * F.lit(w) if w != 1.0 else s).alias(name))
    if squares:
        aggs.append(F.sum(F.col("t") * F.col("t")).alias("tt"))
    return obs.groupBy("key").agg(*aggs)


def sum_names(rank: int) -> list[str]:
    """Columns of :func:`mode_sums` beside ``key`` and ``n``."""
    return [name for _, _, name in cell_names(rank)] + rhs_names(rank) + ["tt"]


def sums_schema(rank: int) -> str:
    return ", ".join(["key long", "n long", *[f"{c} double" for c in sum_names(rank)]])


def mode_sums(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], mode: int, rank: int,
              heavy: Mapping[int, DataFrame] | None = None) -> DataFrame:
    """Unweighted normal equations of all columns of ``mode`` per key: ``key, n, ata_p_q, atb_p, tt`` (A3).

    They depend on the other modes' factors only. The row of ``mode`` is one per key, so the equations of any block of
    columns and the squared error follow from them key by key, for any rows (:func:`block_equations`, :func:`error_of_sums`):
    as long as no other factor of the tensor changes the entries need not be read or moved again.
    """
    obs = observations(spark, tensor, factors, mode, list(range(rank)), rank, heavy=heavy)
    return normal_equations(obs, rank, squares=True)


def sums_with_rows(sums: Sequence[DataFrame], rows: Sequence[tuple[str, DataFrame]], rank: int) -> DataFrame:
    """Sums of some sides (:func:`mode_sums`) and factor rows by key, in one aggregate.

    ``rows``: (label, factor ``idx, v``); the row lands in ``{label}_0..``, the number of rows in ``has_{label}``. Output:
    ``key, n_{side}, s{side}_{sum}.., has_{label}, {label}_c..``; a key without entries has ``n_{side}`` 0 and null sums.
    """
    null = "CAST(NULL AS DOUBLE)"
    sides, labels = range(len(sums)), [label for label, _ in rows]
    cells = [(i, c) for i in sides for c in sum_names(rank)]
    own = [(label, c) for label in labels for c in range(rank)]
    parts = [s.selectExpr("key", f"{i} AS _s", "n AS _n", *[f"{c if i == j else null} AS s{j}_{c}" for j, c in cells],
                          *[f"{null} AS {label}_{c}" for label, c in own]) for i, s in enumerate(sums)]
    parts += [f.selectExpr("idx AS key", f"{-1 - i} AS _s", "0L AS _n", *[f"{null} AS s{j}_{c}" for j, c in cells],
                           *[f"{f'v[{c}]' if label == mine else null} AS {label}_{c}" for label, c in own])
              for i, (mine, f) in enumerate(rows)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    aggs = [f"max(CASE WHEN _s = {i} THEN _n ELSE 0L END) AS n_{i}" for i in sides]
    aggs += [f"max(s{j}_{c}) AS s{j}_{c}" for j, c in cells]
    aggs += [f"count(CASE WHEN _s = {-1 - i} THEN 1 END) AS has_{label}" for i, label in enumerate(labels)]
    aggs += [f"max({label}_{c}) AS {label}_{c}" for label, c in own]
    return u.groupBy("key").agg(*[F.expr(a) for a in aggs])


def block_equations(side: int, label: str, block: Sequence[int], rank: int) -> dict[str, str]:
    """SQL of the unweighted equations of ``block`` by name, from the sums of ``side`` and the key's row ``label``.

    The residual of the other columns is taken off the sums (P5): ``b - A[block, rest] v[rest]``.
    """
    def cell(p: int, q: int) -> str:
        return f"s{side}_ata_{min(p, q)}_{max(p, q)}"

    rest = [r for r in range(rank) if r not in set(block)]
    out = {name: cell(block[p], block[q]) for p, q, name in cell_names(len(block))}
    for p, name in enumerate(rhs_names(len(block))):
        out[name] = " - ".join([f"s{side}_atb_{block[p]}", *[f"{cell(block[p], r)} * {label}_{r}" for r in rest]])
    return out


def error_of_sums(side: int, rank: int, row: Sequence[str]) -> str:
    """SQL of the squared error of a key's entries at the row whose cells are the expressions ``row``, from its sums.

    The difference of sums loses digits only where the error is far below the values' squares; it is never negative.
    """
    linear = " + ".join(f"{x} * s{side}_{name}" for x, name in zip(row, rhs_names(rank)))
    square = " + ".join(f"{'' if p == q else '2D * '}{row[p]} * {row[q]} * s{side}_{name}" for p, q, name in cell_names(rank))
    return f"CASE WHEN n_{side} > 0 THEN greatest(0D, s{side}_tt - 2D * ({linear}) + {square}) END"


def finite_row(label: str, rank: int) -> str:
    """SQL condition: the key has exactly one, finite factor row ``label``."""
    total = " + ".join(f"{label}_{c}" for c in range(rank))
    return f"has_{label} = 1 AND ({total}) * 0D = 0D"


def checked_row(label: str, rank: int, row: str) -> str:
    """SQL for ``row`` of a key that has exactly one, finite factor row; any other key fails."""
    return (f"CASE WHEN {finite_row(label, rank)} THEN {row} ELSE raise_error(concat("
            f"'no finite factor row (exactly one) for key ', CAST(key AS STRING))) END")


def merge_normal(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Merge two tensors' equations (A4) on keys seen in both.

    Both inputs are already one row per key, so this inner join moves one
    row per key and no entry lists.
    """
    names = [n for _, _, n in cell_names(k)] + rhs_names(k)
    bb = b.select(F.col("key").alias("_bkey"), F.col("n").alias("_bn"),
                  *[F.col(c).alias(f"_b_{c}") for c in names])
    j = a.join(bb, a["key"] == bb["_bkey"], "inner")
    return j.select("key", (F.col("n") + F.col("_bn")).alias("n"),
                    *[(F.col(c) + F.col(f"_b_{c}")).alias(c) for c in names])


def add_mean_pull(df: DataFrame, k: int, length: int, own_means: Sequence[float],
                  other_means: Sequence[float], weight: float = 1.0, x_col: str = "v",
                  x_cols: Sequence[str] | None = None) -> DataFrame:
    """Add the leave-one-out mean pseudo-observations (P7) to keyed equations.

    For every column c the reference adds one observation with design
    ``e_c / len`` and target ``z_c = other_mean[c] - (own_mean[c] - x_c / len)``,
    where ``x_c`` is the key's current value. That adds ``w / len^2`` to the
    diagonal cell (c, c) and ``w z_c / len`` to ``atb_c``. ``df`` must carry
    the current row, as the array ``x_col`` or as the columns ``x_cols``;
    null equations stay null.
    """
    L = float(length)
    w = float(weight)
    cols: dict[str, Column] = {}
    for c in range(k):
        x = x_cols[c] if x_cols is not None else f"{x_col}[{c}]"
        lf = f"CAST({L!r} AS DOUBLE)"
        z = f"(CAST({float(other_means[c])!r} AS DOUBLE) - (CAST({float(own_means[c])!r} AS DOUBLE) - {x} / {lf}))"
        cols[f"ata_{c}_{c}"] = F.expr(f"ata_{c}_{c} + CAST({w / (L * L)!r} AS DOUBLE)")
        cols[f"atb_{c}"] = F.expr(f"atb_{c} + CAST({w!r} AS DOUBLE) * {z} / {lf}")
    return df.withColumns(cols)


def gradient_by_key(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], mode: int,
                    rank: int, weight: float = 1.0, heavy: Mapping[int, DataFrame] | None = None) -> DataFrame:
    """Keyed gradient of the data term (A11): ``key, g_0..g_{rank-1}``.

    ``g = sum_entries 2 w (a . x - y) a`` with ``x`` the key's current row of
    ``mode`` and ``a`` its design. At a stationary point of the ridge
    objective it equals ``-2 lam x`` (plus any mean-pull term).
    """
    n = tensor.n_modes
    others = [k for k in range(n) if k != mode]
    j = join_factors(spark, tensor.entries, factors, tensor.dims, others + [mode], rank, heavy)
    a = [row_product([f"f{k}" for k in others], r) for r in range(rank)]
    resid = cp_sum([f"f{k}" for k in range(n)], range(rank)) - F.col("y")
    scale = F.lit(2.0 * float(weight)) * resid
    return j.groupBy(F.col(f"i{mode}").alias("key")).agg(
        *[F.sum(scale * a[r]).alias(f"g_{r}") for r in range(rank)]
    )
