"""Normal equations for wide blocks: partial Gram matrices in Arrow batches.

With ``k`` columns a block needs ``k(k+1)/2 + k`` sums per key; past a few
dozen columns one ``sum`` per cell leaves whole-stage codegen and the cost
grows with ``k^2`` per entry. This path does the same algebra in NumPy:

1. map side, no shuffle: observations sorted within their partition by key
   (the cached entries are already range-clustered on it) go through
   ``mapInPandas``, which sums ``a a^T`` and ``t a`` over each run of equal
   keys. What is carried across Arrow batches is the running sum of the last
   key, never its rows. A partition emits one partial row per key it holds;
2. with many partitions, a first merge on ``(key, slot)``, where the slot
   stands for about the square root of all partitions, so that a key present in
   all of them meets at most that many rows twice instead of all at once;
3. one shuffle on the key, joined by the current factor rows: sums are
   merged the same way, the mean pull and ridge term added, and all keys of
   a batch solved together; keys without entries keep their rows.

Summed rows are made for at most ``_CHUNK_CELLS`` cells at a time. Where a row has more than ``PIECE`` cells (44 columns
and more), it travels in pieces: the packed triangle, right-hand side and counts of a key are cut into rows ``(key, part)`` of
``PIECE`` cells, so that an Arrow batch of 10,000 rows stays under 80 MB whatever the rank. The pieces are summed on
``(key, part)`` first, which also spreads a hot key, then brought together by key and put back for as many keys at a
time as ``_CHUNK_CELLS`` allows (rank 200: 195 keys, 32 MB of sums and 62 MB of matrices).

So memory per task is bounded by the Arrow batch and the chunk, not by the number of entries or partial rows of any
key. A key with entries but without a finite factor row, or with equations that are not finite, fails like on the
``sum`` path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from twinfold.operators.solve import NotFinite, solve_equations

# Blocks with at least this many columns use the Gram path.
GRAM_MIN_K = 9
# Cells of temporary product matrices per chunk (bounds NumPy memory).
_CHUNK_CELLS = 4_000_000
# Cells of a piece of a summed row; longer rows travel in pieces.
PIECE = 1024
# Partial rows are merged in two steps when the map side has more partitions than this.
TWO_STEP_PARTITIONS = 256


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _gram_rows(a: np.ndarray, t: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Per-run sums of the upper triangle of ``a a^T``, then of ``t a``, then of ``t^2``."""
    iu0, iu1 = np.triu_indices(k)
    tri = len(iu0)
    width = tri + k + 1
    n = a.shape[0]
    out = np.zeros((len(starts), width))
    step = max(1, _CHUNK_CELLS // width)
    run_of_row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        prod = np.empty((hi - lo, width))
        prod[:, :tri] = a[lo:hi, iu0] * a[lo:hi, iu1]
        prod[:, tri:-1] = a[lo:hi] * t[lo:hi, None]
        prod[:, -1] = t[lo:hi] ** 2
        runs = run_of_row[lo:hi]
        local = _starts(runs)
        sums = np.add.reduceat(prod, local, axis=0)
        out[runs[local]] += sums
    return out


def running_sums(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per-key sums of key-sorted ``(keys, values)`` batches, every key once.

    One summed row is held back per batch (its key may go on in the next one); a key with any number of rows
    is carried as that one row.
    """
    held_key, held = None, None
    for keys, values in batches:
        if not len(keys):
            continue
        if np.any(keys[1:] < keys[:-1]) or (held_key is not None and keys[0] < held_key):
            raise ValueError("keys must arrive sorted within a partition")
        starts = _starts(keys)
        sums = np.add.reduceat(values, starts, axis=0)
        heads = keys[starts]
        if held_key is not None:
            if heads[0] == held_key:
                sums[0] += held
            else:
                heads, sums = np.r_[held_key, heads], np.concatenate([held[None], sums])
        held_key, held = heads[-1], sums[-1].copy()
        if len(heads) > 1:
            yield heads[:-1], sums[:-1]
    if held_key is not None:
        yield np.array([held_key]), held[None]


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def _partial_batch(keys: np.ndarray, side: int, values: np.ndarray) -> pa.RecordBatch:
    """Rows ``key, _s, n, g`` from summed values (count first, then the equations)."""
    width = values.shape[1] - 1
    flat = pa.array(np.ascontiguousarray(values[:, 1:]).ravel())
    g = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width), flat)
    return pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), side, np.int32)),
                            pa.array(np.rint(values[:, 0]).astype(np.int64)), g], names=["key", "_s", "n", "g"])


PARTIAL_SCHEMA = "key long, _s int, n long, g array<double>"
PIECE_SCHEMA = "key long, part int, g array<double>"


def _summed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run of keys in key-sorted observations: the count, then the packed equations; so many runs at a time."""
    step = max(1, _CHUNK_CELLS // (k * (k + 1) // 2 + k + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        starts = _starts(keys)
        ends = np.r_[starts[1:], len(keys)]
        a = np.stack([batch.column(f"a_{i}").to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
        t = batch.column("t").to_numpy(zero_copy_only=False)
        for lo in range(0, len(starts), step):
            some = starts[lo:lo + step]
            first, last = some[0], ends[lo:lo + step][-1]
            g = _gram_rows(a[first:last], t[first:last], some - first, k)
            yield keys[some], np.concatenate([(ends[lo:lo + step] - some)[:, None].astype(float), g], axis=1)


def partial_grams(obs: DataFrame, k: int, side: int = 0) -> DataFrame:
    """Map-side partial equations: ``key, _s, n, g`` (``g`` = triangle, rhs, squared targets)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in running_sums(_summed(batches, k)):
            yield _partial_batch(keys, side, values)

    return obs.sortWithinPartitions("key").mapInArrow(fn, PARTIAL_SCHEMA)


def _piece_batch(keys: np.ndarray, parts: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * g.shape[1]), pa.array(np.ascontiguousarray(g).ravel()))
    return pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(parts.astype(np.int32)), cells], names=["key", "part", "g"])


def partial_pieces(obs: DataFrame, k: int, side: int, n_sides: int, weight: float, piece: int) -> DataFrame:
    """Map-side partial equations in pieces ``key, part, g``: entry counts of all sides (only ``side`` has any), then weighted sums."""
    width = n_sides + k * (k + 1) // 2 + k + 1
    parts = -(-width // piece)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in running_sums(_summed(batches, k)):
            rows = np.zeros((len(keys), parts * piece))
            rows[:, side] = values[:, 0]
            rows[:, n_sides:width] = weight * values[:, 1:]
            yield _piece_batch(np.repeat(keys, parts), np.tile(np.arange(parts), len(keys)), rows.reshape(-1, piece))

    return obs.sortWithinPartitions("key").mapInArrow(fn, PIECE_SCHEMA)


def _piece_sums(batches: Iterator[pa.RecordBatch], kinds: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums per (key, part) as ``key * kinds + part``; shorter pieces are filled up to ``cells``."""
    def values() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            lengths = batch.column("g").value_lengths().to_numpy()
            g = np.zeros((batch.num_rows, cells))
            g[np.arange(cells) < lengths[:, None]] = batch.column("g").flatten().to_numpy(zero_copy_only=False)
            yield batch.column("key").to_numpy() * kinds + batch.column("part").to_numpy(), g

    return running_sums(values())


def merge_pieces(pieces: DataFrame, kinds: int, piece: int) -> DataFrame:
    """One row per (key, part)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums in _piece_sums(batches, kinds, piece):
            yield _piece_batch(ids // kinds, ids % kinds, sums)

    return pieces.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(fn, PIECE_SCHEMA)


def _put_back(sums: Iterator[tuple[np.ndarray, np.ndarray]], kinds: int, places: Sequence[tuple[int, int]],
              ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole rows of keys from their pieces; ``places``: first and last cell of every part."""
    width = max(hi for _, hi in places)
    cap = max(1, _CHUNK_CELLS // width)
    held, rows = np.empty(0, np.int64), np.empty((0, width))
    for ids, g in sums:
        key, part = ids // kinds, ids % kinds
        heads = _starts(key)
        for lo in range(0, len(heads), cap):
            first, last = heads[lo], np.r_[heads, len(key)][min(lo + cap, len(heads))]
            at = np.searchsorted(heads[lo:lo + cap], np.arange(first, last), side="right") - 1
            block, names = np.zeros((len(heads[lo:lo + cap]), width)), key[heads[lo:lo + cap]]
            for p in np.unique(part[first:last]):
                on = part[first:last] == p
                a, b = places[p]
                block[at[on], a:b] = g[first:last][on, :b - a]
            if len(held) and held[-1] == names[0]:
                rows[-1] += block[0]
                names, block = names[1:], block[1:]
            held, rows = np.r_[held, names], np.concatenate([rows, block])
            if len(held) > cap:
                # The last key may go on.
                yield held[:-1], rows[:-1]
                held, rows = held[-1:], rows[-1:].copy()
    if len(held):
        yield held, rows


def merge_slots(partials: DataFrame, k: int, side: int, slots: int) -> DataFrame:
    """First merge of partial rows: one row per key and slot, the slot being the map partition modulo ``slots``."""
    width = k * (k + 1) // 2 + k + 1

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            g = batch.column("g").flatten().to_numpy().reshape(-1, width)
            yield batch.column("key").to_numpy(), np.concatenate([n[:, None], g], axis=1)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in running_sums(values(batches)):
            yield _partial_batch(keys, side, sums)

    slotted = partials.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(int(slots))))
    # Rows of one key in several slots of a task may meet already; their sum is what the next step needs.
    return slotted.repartition("key", "_slot").sortWithinPartitions("key").select("key", "n", "g").mapInArrow(fn, PARTIAL_SCHEMA)


def _unpack(g: np.ndarray, k: int, lam: float) -> tuple[np.ndarray, np.ndarray]:
    iu0, iu1 = np.triu_indices(k)
    tri = len(iu0)
    a = np.zeros((g.shape[0], k, k))
    a[:, iu0, iu1] = g[:, :tri]
    a[:, iu1, iu0] = g[:, :tri]
    d = np.arange(k)
    a[:, d, d] += lam
    return a, g[:, tri:tri + k].copy()


def merge_and_solve(partials: Sequence[DataFrame], factors: Sequence[DataFrame], k: int, rank: int,
                    start: int, lam: float, weights: Sequence[float], mean_pull=None,
                    labels: Sequence[tuple[int, int]] | None = None, slots: int | None = None,
                    with_error: bool = False, piece: int | None = None) -> DataFrame:
    """Reduce side: sum partial rows per key, solve, and write the block.

    ``partials``: one partial table per side (same keys domain). One side (M4, M5): every key with entries is solved.
    Several (M6): keys with entries on at least two sides are, for the factors of the sides that have them.
    ``factors``: the current factor of each output (one, or one per side for M6).
    ``mean_pull``: ``(length, own_means, other_means, weight)`` or None.
    ``slots``: merge in two steps over so many slots (None: only with more
    than ``TWO_STEP_PARTITIONS`` shuffle partitions).
    ``with_error``: add ``sse``, the squared error of the key's entries at the
    new row (one side only; null without entries).
    ``piece``: the partial tables are those of :func:`partial_pieces` with so many cells (weights are in them).
    Returns ``idx, v`` for one factor, or ``tensor, mode, idx, v`` rows for
    each label when ``labels`` is given.
    """
    n_sides, n_out = len(partials), len(factors)
    width = k * (k + 1) // 2 + k + 1
    w = [float(x) for x in weights]
    # One summed row per key: counts per side, equations, then per output the number of factor rows and the row.
    at_row = n_sides + width

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pdf in batches:
            side = pdf["_s"].to_numpy()
            out = np.zeros((len(pdf), at_row + n_out * (1 + rank)))
            for s in range(n_sides):
                m = side == s
                if m.any():
                    out[m, s] = pdf["n"].to_numpy()[m]
                    out[m, n_sides:at_row] = w[s] * _stack(pdf["x"][m], width)
            for j in range(n_out):
                m = side == -1 - j
                if m.any():
                    lo = at_row + j * (1 + rank)
                    out[m, lo] = 1.0
                    cells = [np.asarray(v, dtype=float) if v is not None and len(v) == rank else np.full(rank, np.nan)
                             for v in pdf["x"].to_numpy()[m]]
                    out[m, lo + 1:lo + 1 + rank] = np.stack(cells)
            yield pdf["key"].to_numpy(), out

    def solved(whole: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for keys, sums in whole:
            seen = sums[:, :n_sides] > 0
            due = seen.sum(axis=1) >= min(2, n_sides)
            olds = []
            for j in range(n_out):
                lo = at_row + j * (1 + rank)
                old = sums[:, lo + 1:lo + 1 + rank]
                wrong = (sums[:, lo] != 1) | ~np.isfinite(old).all(axis=1)
                if wrong.any():
                    raise NotFinite(f"no finite factor row (exactly one) for keys {keys[wrong][:10].tolist()}")
                olds.append(old)
            a, b = _unpack(sums[due, n_sides:at_row], k, lam)
            if with_error:
                plain, rhs = _unpack(sums[due, n_sides:at_row], k, 0.0)
            if mean_pull is not None:
                length, own, other, w2 = mean_pull
                x_old = olds[0][due][:, start:start + k]
                z = np.asarray(other)[None, start:start + k] - (np.asarray(own)[None, start:start + k] - x_old / length)
                d = np.arange(k)
                a[:, d, d] += w2 / (length * length)
                b += w2 * z / length
            x = solve_equations(a, b, keys[due])
            if with_error:
                sse = np.full(len(keys), np.nan)
                sse[due] = (sums[due, at_row - 1] - 2 * (x * rhs).sum(1) + np.einsum("ni,nij,nj->n", x, plain, x)) / w[0]
            for j in range(n_out):
                v = olds[j].copy()
                own = seen[due, j]
                v[np.flatnonzero(due)[own], start:start + k] = x[own]
                out = {"idx": keys.astype("int64"), "v": list(v)}
                if with_error:
                    out["sse"] = pd.array(np.where(due, np.maximum(sse, 0.0), 0.0), dtype="Float64")
                    out["sse"][~due] = pd.NA
                if labels is not None:
                    out = {"tensor": np.full(len(keys), labels[j][0], dtype="int32"),
                           "mode": np.full(len(keys), labels[j][1], dtype="int32")} | out
                yield pd.DataFrame(out)

    schema = "idx long, v array<double>, sse double" if with_error else "idx long, v array<double>" if labels is None else "tensor int, mode int, idx long, v array<double>"
    if piece is not None:
        parts = -(-at_row // piece)
        kinds = parts + n_out
        rows = None
        for p in partials:
            rows = p if rows is None else rows.unionByName(p)
        rows = merge_pieces(rows, kinds, piece)
        row = f"CASE WHEN size(v) = {rank} THEN v ELSE array_repeat(double('NaN'), {rank}) END"
        for j, f in enumerate(factors):
            rows = rows.unionByName(f.selectExpr("idx AS key", f"{parts + j} AS part", f"concat(array(1D), transform({row}, c -> coalesce(c, double('NaN')))) AS g"))
        places = [(p * piece, min((p + 1) * piece, at_row)) for p in range(parts)]
        places += [(at_row + j * (1 + rank), at_row + (j + 1) * (1 + rank)) for j in range(n_out)]

        def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pdf in solved(_put_back(_piece_sums(batches, kinds, max(piece, 1 + rank)), kinds, places)):
                yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

        arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)])
        return rows.repartition("key").sortWithinPartitions("key", "part").mapInArrow(put_back, schema)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return solved(running_sums(values(batches)))

    if slots is None:
        tasks = int(partials[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slots = math.isqrt(tasks) if tasks > TWO_STEP_PARTITIONS else 0
    rows = None
    for s, p in enumerate(partials):
        if slots:
            p = merge_slots(p, k, s, slots)
        part = p.selectExpr("key", f"{s} AS _s", "n", "g AS x")
        rows = part if rows is None else rows.unionByName(part)
    for j, f in enumerate(factors):
        rows = rows.unionByName(f.selectExpr("idx AS key", f"{-1 - j} AS _s", "CAST(1 AS long) AS n", "v AS x"))
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(fn, schema)
