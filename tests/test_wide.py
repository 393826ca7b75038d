"""Wide blocks in pieces, paged coupled slices, range rescale, one-pass checks and verdicts over a log."""

import math

import numpy as np
import pytest

from twinfold.operators import gram, predict, stopping, tensor, update
from twinfold.spec import Options, Stop, Tensor


def _matrix(spark, seed, dims, n):
    rng = np.random.default_rng(seed)
    idx = np.stack([rng.integers(d, size=n) for d in dims], axis=1)
    y = rng.normal(size=n)
    t = Tensor(spark.createDataFrame([(*map(int, r), float(v)) for r, v in zip(idx, y)], "i0 long, i1 long, y double"), dims)
    return t, idx, y


def _factor(spark, seed, dim, rank):
    f = np.random.default_rng(seed).normal(size=(dim, rank))
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(f)], "idx long, v array<double>"), f


@pytest.mark.parametrize("rank,piece,cells", [(200, None, 4_000_000), (5, 3, 60)])
def test_pieces_equal_numpy(spark, monkeypatch, rank, piece, cells):
    monkeypatch.setattr(gram, "_CHUNK_CELLS", cells)
    t, idx, y = _matrix(spark, 1, (6, 30), 150)
    (f0, a0), (f1, a1) = _factor(spark, 2, 6, rank), _factor(spark, 3, 30, rank)
    got = {r.idx: (r.v, r.sse) for r in update.update_uncoupled(
        spark, t, {0: f0, 1: f1}, 0, rank, Options(0.7), 0, method="gram", with_error=True, piece=piece).collect()}
    assert len(got) == 6
    for k in range(6):
        a, b = a1[idx[idx[:, 0] == k, 1]], y[idx[:, 0] == k]
        x = np.linalg.solve(a.T @ a + 0.7 * np.eye(rank), a.T @ b) if len(b) else a0[k]
        assert got[k][0] == pytest.approx(list(x), rel=1e-7, abs=1e-9)
        assert got[k][1] == pytest.approx(((b - a @ x) ** 2).sum(), rel=1e-6, abs=1e-8)


def test_coupled_entries_are_lossless_under_a_hot_key(spark):
    a, ia, _ = _matrix(spark, 4, (500, 3), 300)
    b, ib, _ = _matrix(spark, 5, (500, 4), 40)
    pages = tensor.coupled_entries(a, 1, b, 1, page=10).collect()
    for side, idx in (("entries_a", ia), ("entries_b", ib)):
        got = sorted((e.i0, e.i1) for p in pages for e in p[side])
        assert got == sorted(map(tuple, idx[np.isin(idx[:, 1], list(set(ia[:, 1]) & set(ib[:, 1])))].tolist()))
    assert max(len(p.entries_a) for p in pages) < 60 and len({(p.key, p.page) for p in pages}) == len(pages)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_rescale_with_gaps_overlaps_and_open_ends(spark, broadcast):
    rows = [(None, 10, 2.0), (5, 30, 3.0), (20, 30, 4.0), (40, 45, 5.0), (45, 45, 6.0), (60, None, 7.0), (41, 44, None), (90, 200, 8.0), (-5, 3, 9.0)]
    ranges = spark.createDataFrame(rows, "lo long, hi long, scale double")
    df = spark.range(-2, 110).selectExpr("IF(id = 109, NULL, id) AS i1", "2D AS yhat", "1 AS bin")
    got = {r.i1: r.yhat for r in predict.rescale(df, ranges, 100, otherwise=0.5, max_broadcast=broadcast).collect()}
    assert len(got) == 112

    def want(i):
        held = [] if i is None or not 0 <= i < 100 else sorted(
            (min(100, 100 if hi is None else hi), max(0, lo or 0), s) for lo, hi, s in rows
            if s is not None and (lo or 0) <= i < (100 if hi is None else hi))
        return 2 * (held[0][2] if held else 0.5)

    assert got == {i: want(i) for i in got}


def test_duplicates_by_hash_with_a_hot_coordinate(spark):
    e = spark.range(1000).selectExpr("IF(id < 400, 7L, id) AS i0", "IF(id < 400, 9L, IF(id % 10 = 0, NULL, id)) AS i1", "CAST(id AS DOUBLE) AS y")
    e = e.unionByName(e.where("y = 501"))
    for bound in (10, 0):
        got = tensor.validate(Tensor(e, (2000, 2000)), max_broadcast=bound).groupBy("issue").count().collect()
        assert {r.issue: r["count"] for r in got} == {"duplicate": 402, "null_index": 60}


def test_verdicts_follow_the_rule_of_the_fit(spark):
    nan, inf = float("nan"), float("inf")
    runs = [[5, 4, 3.999, 3], [5, 6, 2], [5, nan, 4], [5, inf, 4], [inf, 3, 2], [5, 0, 0, 0], [9, 8, 7, 6, 5, 4, 3]]
    stop = Stop(min_rel_decrease=1e-2, max_iter=5, max_hours=1.0)
    rows = [(i, j, 1000.0 * j, float(v)) for i, run in enumerate(runs) for j, v in enumerate(run)]
    got = {(r.run, r.iter): r for r in stopping.verdicts(
        spark.createDataFrame(rows, "run int, iter int, seconds double, loss double"), stop, by=["run"]).collect()}
    for i, run in enumerate(runs):
        prev, ended = stopping.FIRST_LOSS, False
        for j, loss in enumerate(run):
            rel = (prev - loss) / prev if prev else nan
            ended = ended or stop.reached(j, 1000.0 * j, rel)
            assert got[(i, j)].stopped == ended, (i, j)
            assert got[(i, j)].final == (j if j == 0 or rel > 0 else j - 1), (i, j)
            assert (got[(i, j)].rel is None) == (not math.isfinite(rel))
            prev = loss
    assert got[(6, 4)].reason == "hours" and got[(1, 1)].reason == "decrease"
    best = {(r.run, r.iter): (r.best, r["lag"]) for r in stopping.best_iterations(
        spark.createDataFrame(rows, "run int, iter int, seconds double, loss double"), by=["run"]).collect()}
    assert best[(1, 1)] == (0, 1) and best[(2, 1)] == (0, 1) and best[(5, 3)] == (1, 2) and best[(4, 2)] == (2, 0)
