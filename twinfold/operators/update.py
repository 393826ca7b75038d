"""Factor updates (M4-M6): one closed-form ridge solve per observed key.

Plan of one update: the entries (cached) join the other modes' factors
(broadcast when their declared size allows), give one observation each
(design, target), and are unioned with the current factor rows; a single
``groupBy(key)`` then sums the normal equations (partial sums map-side, so a
hot key is combined on every map task) and carries the key's current row
along as ``max`` of its columns (one non-null value per key). That one
shuffle replaces the join of the equations with the old factor. An
Arrow-batched solve follows, and keys without entries keep their rows
(J4/J5), since every factor row passes through the aggregate.

Whatever the path (``sum``, ``gram``, broadcast or shuffle join), the rows are the
same and so are the refusals: an entry without a factor row, a factor row with
a null, NaN or infinite cell, a repeated factor row and equations that are
not finite fail the job, naming keys. Nothing is dropped.

An update may be handed the sums of its entries instead (``normal.mode_sums``, at the current rows of the other modes): it is
then planned over one row per key, and the entries are neither read nor moved.

Each function returns a lazy DataFrame ``(idx, v)`` (M6: ``(tensor, mode,
idx, v)`` for all coupled factors); the fit loop decides where it lands.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.columns import cell_names, rhs_names
from twinfold.operators.gram import GRAM_MIN_K, PIECE, merge_and_solve, partial_grams, partial_pieces
from twinfold.operators.normal import (add_mean_pull, block_equations, checked_row, error_of_sums, finite_row, observations,
                                       sums_with_rows)
from twinfold.operators.solve import solve_column
from twinfold.spec import Options, Tensor


def entry_weight(options: Options, n_entries: int) -> float:
    """1 under LS, 1 / entries under WLS."""
    return 1.0 / n_entries if options.loss == "wls" and n_entries else 1.0


def _equations_with_rows(obs: Sequence[tuple[DataFrame, float]], rows: Sequence[tuple[str, DataFrame]],
                         k: int, rank: int) -> DataFrame:
    """Union observations and factor rows, then one keyed aggregate.

    ``obs``: (observations ``key, a_0.., t``, weight) per side.
    ``rows``: (label, factor ``idx, v``); the row lands in ``{label}_0..``,
    the number of rows in ``has_{label}``.
    Output: ``key, n_{side}.., ata_p_q, atb_p, {label}_c..``; equations are
    null for keys without observations. Expressions go in as SQL text, so
    building the plan costs a handful of calls whatever the rank.
    """
    null = "CAST(NULL AS DOUBLE)"
    labels = [lab for lab, _ in rows]
    row_cols = [f"{lab}_{c}" for lab in labels for c in range(rank)]
    parts = []
    for s, (o, _) in enumerate(obs):
        parts.append(o.selectExpr("key", f"{s} AS _s", *[f"a_{i}" for i in range(k)], "t",
                                  *[f"{null} AS {c}" for c in row_cols]))
    for j, (lab, fac) in enumerate(rows):
        cells = [f"v[{c}] AS {lb}_{c}" if lb == lab else f"{null} AS {lb}_{c}"
                 for lb in labels for c in range(rank)]
        parts.append(fac.selectExpr("idx AS key", f"{-1 - j} AS _s", *[f"{null} AS a_{i}" for i in range(k)],
                                    f"{null} AS t", *cells))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    weights = [float(w) for _, w in obs]
    if all(w == 1.0 for w in weights):
        wsql = ""
    else:
        wsql = "CASE " + " ".join(f"WHEN _s = {s} THEN CAST({w!r} AS DOUBLE)" for s, w in enumerate(weights)) + " END * "
    aggs = [f"count(CASE WHEN _s = {s} THEN 1 END) AS n_{s}" for s in range(len(obs))]
    aggs += [f"sum({wsql}a_{p} * a_{q}) AS {name}" for p, q, name in cell_names(k)]
    aggs += [f"sum({wsql}t * a_{p}) AS {name}" for p, name in enumerate(rhs_names(k))]
    aggs += [f"sum({wsql}t * t) AS tt"]
    aggs += [f"count(CASE WHEN _s = {-1 - j} THEN 1 END) AS has_{lab}" for j, lab in enumerate(labels)]
    aggs += [f"max({c}) AS {c}" for c in row_cols]
    return u.groupBy("key").agg(*[F.expr(a) for a in aggs])


def use_gram(k: int, method: str) -> bool:
    """``method``: ``sum`` (one aggregate column per cell), ``gram`` (NumPy runs), ``auto``."""
    if method not in ("auto", "sum", "gram"):
        raise ValueError(f"unknown method {method!r}")
    return method == "gram" or (method == "auto" and k >= GRAM_MIN_K)


def _partials(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], mode: int,
              block: Sequence[int], rank: int, heavy: Mapping[int, DataFrame] | None, side: int = 0, n_sides: int = 1,
              weight: float = 1.0, piece: int | None = None) -> DataFrame:
    obs = observations(spark, tensor, factors, mode, block, rank, heavy=heavy)
    if piece is not None:
        return partial_pieces(obs, len(block), side, n_sides, weight, piece)
    return partial_grams(obs, len(block), side)


def _piece(k: int, piece: int | None) -> int | None:
    """Cells of a piece if rows of ``k`` columns travel in pieces (always, if ``piece`` is given)."""
    return piece if piece is not None else PIECE if k * (k + 1) // 2 + k + 1 > PIECE else None


def _row(label: str, rank: int) -> str:
    return "array(" + ", ".join(f"{label}_{c}" for c in range(rank)) + ")"


def _equations_of_sums(sums: Sequence[tuple[DataFrame, float]], rows: Sequence[tuple[str, DataFrame]], block: Sequence[int],
                       rank: int) -> DataFrame:
    """:func:`_equations_with_rows` from (sums, weight) per side, each with its row; the sums stay, as ``s{side}_{sum}``."""
    eq = sums_with_rows([s for s, _ in sums], rows, rank)
    cells = [block_equations(i, label, block, rank) for i, (label, _) in enumerate(rows)]
    total = {name: " + ".join(f"CASE WHEN n_{i} > 0 THEN CAST({float(w)!r} AS DOUBLE) * ({c[name]}) ELSE 0D END"
                              for i, (c, (_, w)) in enumerate(zip(cells, sums))) for name in cells[0]}
    return eq.selectExpr("*", *[f"{sql} AS {name}" for name, sql in total.items()])


def _error(k: int, weight: float, names: str = "") -> str:
    """SQL for the squared error of a key's entries at its new block: ``t't - 2 x'b + x'Ax`` from the sums of the solve.

    The difference of sums loses digits only where the error is far below the targets' squares; it is never negative.
    """
    linear = " + ".join(f"_x.x_{p} * {names}atb_{p}" for p in range(k))
    square = " + ".join(f"{'' if p == q else '2D * '}_x.x_{p} * _x.x_{q} * {names}{name}" for p, q, name in cell_names(k))
    return f"CASE WHEN n_0 > 0 THEN greatest(0D, tt - 2D * ({linear}) + {square}) / CAST({float(weight)!r} AS DOUBLE) END"


def _solved_cells(label: str, k: int, start: int, rank: int) -> list[str]:
    return ([f"{label}_{c}" for c in range(start)] + [f"_x.x_{c}" for c in range(k)]
            + [f"{label}_{c}" for c in range(start + k, rank)])


def _solved_row(label: str, k: int, start: int, rank: int) -> str:
    return "array(" + ", ".join(_solved_cells(label, k, start, rank)) + ")"


def update_uncoupled(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], mode: int,
                     rank: int, options: Options, n_entries: int, own_means: Sequence[float] | None = None,
                     other_means: Sequence[float] | None = None, method: str = "auto",
                     heavy: Mapping[int, DataFrame] | None = None, with_error: bool = False, pulls: int = 1,
                     piece: int | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Update an uncoupled mode, full rank, with the mean pull (M4).

    Without means (a single tensor) the mean pull is left out. With ``pulls`` other factors, ``other_means`` is the average
    of their column means: as many pseudo-observations, each with its own target, have the same sums. ``heavy`` hands
    in known heavy indices per mode (only used where a factor is too large to broadcast).
    ``with_error`` adds ``sse``, the squared error of every key's entries at its new row. ``sums``: those of the mode, if known.
    """
    if sums is None and use_gram(rank, method):
        pull = None
        if own_means is not None and other_means is not None:
            pull = (float(tensor.dims[mode]), list(own_means), list(other_means),
                    pulls / rank if options.loss == "wls" else float(pulls))
        weight, cells = entry_weight(options, n_entries), _piece(rank, piece)
        return merge_and_solve([_partials(spark, tensor, factors, mode, list(range(rank)), rank, heavy, weight=weight, piece=cells)],
                               [factors[mode]], rank, rank, 0, options.lam, [weight], pull, with_error=with_error, piece=cells)
    if sums is not None:
        eq = _equations_of_sums([(sums, entry_weight(options, n_entries))], [("old", factors[mode])], list(range(rank)), rank)
    else:
        obs = observations(spark, tensor, factors, mode, list(range(rank)), rank, heavy=heavy)
        eq = _equations_with_rows([(obs, entry_weight(options, n_entries))], [("old", factors[mode])], rank, rank)
    if with_error and sums is None:
        eq = eq.selectExpr("*", *[f"{n} AS data_{n}" for n in [c for _, _, c in cell_names(rank)] + rhs_names(rank)])
    if own_means is not None and other_means is not None:
        w2 = pulls / rank if options.loss == "wls" else float(pulls)
        eq = add_mean_pull(eq, rank, tensor.dims[mode], own_means, other_means, w2,
                           x_cols=[f"old_{c}" for c in range(rank)])
    due = "n_0 > 0" if sums is None else f"n_0 > 0 AND {finite_row('old', rank)}"
    eq = eq.withColumn("_x", solve_column(rank, options.lam, due=due))
    row = f"CASE WHEN n_0 > 0 THEN {_solved_row('old', rank, 0, rank)} ELSE {_row('old', rank)} END"
    sse = (_error(rank, entry_weight(options, n_entries), "data_") if sums is None
           else error_of_sums(0, rank, _solved_cells("old", rank, 0, rank)))
    return eq.selectExpr("key AS idx", f"{checked_row('old', rank, row)} AS v", *([f"{sse} AS sse"] if with_error else []))


def update_specific(spark: SparkSession, tensor: Tensor, factors: Mapping[int, DataFrame], mode: int,
                    rank: int, common: int, options: Options, n_entries: int, method: str = "auto",
                    heavy: Mapping[int, DataFrame] | None = None, with_error: bool = False,
                    piece: int | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Update the specific block ``[common, rank)`` of a coupled mode (M5); ``with_error`` and ``sums`` as in M4."""
    if not 0 <= common < rank:
        raise ValueError("the specific block is empty")
    block = list(range(common, rank))
    k = len(block)
    if sums is None and use_gram(k, method):
        weight, cells = entry_weight(options, n_entries), _piece(k, piece)
        return merge_and_solve([_partials(spark, tensor, factors, mode, block, rank, heavy, weight=weight, piece=cells)], [factors[mode]],
                               k, rank, common, options.lam, [weight], with_error=with_error, piece=cells)
    if sums is not None:
        eq = _equations_of_sums([(sums, entry_weight(options, n_entries))], [("old", factors[mode])], block, rank)
        due, sse = f"n_0 > 0 AND {finite_row('old', rank)}", error_of_sums(0, rank, _solved_cells("old", k, common, rank))
    else:
        obs = observations(spark, tensor, factors, mode, block, rank, heavy=heavy)
        eq = _equations_with_rows([(obs, entry_weight(options, n_entries))], [("old", factors[mode])], k, rank)
        due, sse = "n_0 > 0", _error(k, entry_weight(options, n_entries))
    eq = eq.withColumn("_x", solve_column(k, options.lam, due=due))
    row = f"CASE WHEN n_0 > 0 THEN {_solved_row('old', k, common, rank)} ELSE {_row('old', rank)} END"
    return eq.selectExpr("key AS idx", f"{checked_row('old', rank, row)} AS v", *([f"{sse} AS sse"] if with_error else []))


class Side(NamedTuple):
    """One tensor of a common update: its entries, factors, coupled mode, entry count, label of the output, heavy indices and,
    if they are known, the sums of the mode."""

    tensor: Tensor
    factors: Mapping[int, DataFrame]
    mode: int
    n_entries: int
    label: tuple[int, int]
    heavy: Mapping[int, DataFrame] | None = None
    sums: DataFrame | None = None


def update_shared(spark: SparkSession, sides: Sequence[Side], rank: int, common: int, options: Options,
                  method: str = "auto", piece: int | None = None) -> DataFrame:
    """Update the shared block ``[0, common)`` of all coupled factors at once (M6).

    ``sides`` are two or more tensors, of any mode counts, each coupled by a mode at any position. The equations of all
    sides are summed per key (A4). A key is solved where at least two tensors have entries (J3), from the entries of all
    that have; the solution goes to the factors of those tensors, and a tensor without entries on the key keeps its row.
    Where all sides come with their sums, the equations are made of them.
    Returns ``(tensor, mode, idx, v)`` rows for all factors, so one write lands them.
    """
    if not 0 < common <= rank:
        raise ValueError("the common block is empty")
    if len(sides) < 2:
        raise ValueError("a common block needs two tensors")
    block = list(range(common))
    weights = [entry_weight(options, s.n_entries) for s in sides]
    summed = all(s.sums is not None for s in sides)
    if not summed and use_gram(common, method):
        cells = _piece(common, piece)
        partials = [_partials(spark, s.tensor, s.factors, s.mode, block, rank, s.heavy, i, len(sides), weights[i], cells)
                    for i, s in enumerate(sides)]
        return merge_and_solve(partials, [s.factors[s.mode] for s in sides], common, rank, 0, options.lam, weights, None,
                               [s.label for s in sides], piece=cells)
    names = [f"v{i}" for i in range(len(sides))]
    own = [(n, s.factors[s.mode]) for n, s in zip(names, sides)]
    if summed:
        eq = _equations_of_sums([(s.sums, w) for s, w in zip(sides, weights)], own, block, rank)
    else:
        obs = [observations(spark, s.tensor, s.factors, s.mode, block, rank, heavy=s.heavy) for s in sides]
        eq = _equations_with_rows(list(zip(obs, weights)), own, common, rank)
    seen = "(" + " + ".join(f"CAST(n_{i} > 0 AS INT)" for i in range(len(sides))) + ") > 1"
    cells = [n for _, _, n in cell_names(common)] + rhs_names(common)
    eq = eq.withColumns({n: F.expr(f"CASE WHEN {seen} THEN {n} END") for n in cells})
    due = " AND ".join([seen, *[finite_row(n, rank) for n in names if summed]])
    eq = eq.withColumn("_x", solve_column(common, options.lam, due=due))
    rows = []
    for i, (name, side) in enumerate(zip(names, sides)):
        row = f"CASE WHEN {seen} AND n_{i} > 0 THEN {_solved_row(name, common, 0, rank)} ELSE {_row(name, rank)} END"
        t, m = side.label
        rows.append(f"named_struct('tensor', {t}, 'mode', {m}, 'v', {checked_row(name, rank, row)})")
    out = eq.selectExpr("key AS idx", f"explode(array({', '.join(rows)})) AS _r")
    return out.selectExpr("_r.tensor AS tensor", "_r.mode AS mode", "idx", "_r.v AS v")


def update_common(spark: SparkSession, a: Tensor, fa: Mapping[int, DataFrame], mode_a: int, na: int,
                  b: Tensor, fb: Mapping[int, DataFrame], mode_b: int, nb: int, rank: int, common: int,
                  options: Options, labels: tuple[tuple[int, int], tuple[int, int]] = ((0, 1), (1, 1)),
                  method: str = "auto",
                  heavy: tuple[Mapping[int, DataFrame] | None, Mapping[int, DataFrame] | None] = (None, None),
                  ) -> DataFrame:
    """:func:`update_shared` of two tensors: only keys seen in both are solved."""
    return update_shared(spark, [Side(a, fa, mode_a, na, labels[0], heavy[0]), Side(b, fb, mode_b, nb, labels[1], heavy[1])],
                         rank, common, options, method)
