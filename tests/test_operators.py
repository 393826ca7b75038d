import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinfold.operators import factors as fo
from twinfold.operators import normal, predict, solve, tensor, update
from twinfold.spec import Options, Stop, Tensor


def _tensor(spark, rows, dims):
    df = spark.createDataFrame(rows, "i0 long, i1 long, y double")
    return Tensor(df, dims)


def test_validate_reports_each_issue(spark):
    t = _tensor(spark, [(0, 0, 1.0), (0, 0, 2.0), (5, 0, 1.0), (1, 1, float("nan"))], (2, 2))
    issues = sorted((r.i0, r.issue) for r in tensor.validate(t).collect())
    assert issues == [(0, "duplicate"), (0, "duplicate"), (1, "bad_value"), (5, "out_of_range")]
    with pytest.raises(ValueError):
        tensor.check(t)


def test_slices_and_coupled_slices(spark):
    a = _tensor(spark, [(0, 0, 1.0), (1, 0, 2.0), (0, 2, 3.0)], (2, 3))
    b = _tensor(spark, [(0, 0, 1.0), (0, 1, 1.0)], (1, 3))
    cs = sorted(tuple(r) for r in tensor.coupled_slices(a, 1, b, 1).collect())
    assert cs == [(0, 2, 1)]  # key 1 only in b, key 2 only in a: dropped
    g = {r.key: len(r.entries) for r in tensor.group_by_mode(a, 1).collect()}
    assert g == {0: 2, 2: 1}
    rows = [(0, i, float(i)) for i in range(50)] + [(1, 0, 2.0), (1, 0, 2.0)]
    pages = tensor.group_by_mode(_tensor(spark, rows, (2, 50)), 0, page=8).collect()
    assert sorted((r.key, e.i1, e.y) for r in pages for e in r.entries) == sorted(rows)
    assert len([r for r in pages if r.key == 0]) > 4 and all(r.n == len(r.entries) < 20 for r in pages)
    assert tensor.count_entries(a).first().n == 3


def test_init_methods(spark):
    f = fo.init_factor(spark, 4, 3, "diagonal", value=2.0).orderBy("idx").collect()
    assert [list(r.v) for r in f] == [[2, 0, 0], [0, 2, 0], [0, 0, 2], [0, 0, 0]]
    r1 = fo.init_factor(spark, 50, 3, "random", 0, 1, seed=3, partitions=1).orderBy("idx").collect()
    r2 = fo.init_factor(spark, 50, 3, "random", 0, 1, seed=3, partitions=7).orderBy("idx").collect()
    assert r1 == r2 and all(0 <= x < 1 for r in r1 for x in r.v)
    dr = fo.init_factor(spark, 5, 2, "diagonal_random", diag_rows=2).orderBy("idx").collect()
    assert list(dr[0].v) == [1.0, 0.0] and list(dr[1].v) == [0.0, 1.0]


def test_upserts_keep_unobserved_rows(spark):
    old = spark.createDataFrame([(i, [float(i)] * 3) for i in range(4)], "idx long, v array<double>")
    new = spark.createDataFrame([(1, [9.0, 9.0, 9.0])], "idx long, v array<double>")
    got = {r.idx: list(r.v) for r in fo.upsert_rows(old, new).collect()}
    assert got == {0: [0.0] * 3, 1: [9.0] * 3, 2: [2.0] * 3, 3: [3.0] * 3}
    blk = spark.createDataFrame([(2, [7.0])], "idx long, x array<double>")
    got = {r.idx: list(r.v) for r in fo.upsert_block(old, blk, 1, 2, 3).collect()}
    assert got[2] == [2.0, 7.0, 2.0] and got[0] == [0.0, 0.0, 0.0]


def test_solve_batch_and_not_pd():
    rng = np.random.default_rng(0)
    k = 4
    rows = []
    mats = []
    for i in range(20):
        a = rng.normal(size=(10, k))
        m = a.T @ a
        b = rng.normal(size=k)
        mats.append((m, b))
        row = {"key": i, "due": True}
        for p in range(k):
            for q in range(p, k):
                row[f"ata_{p}_{q}"] = m[p, q]
            row[f"atb_{p}"] = b[p]
        rows.append(row)
    x = solve.solve_batch(pd.DataFrame(rows), k, 0.5)
    for i, (m, b) in enumerate(mats):
        np.testing.assert_allclose(x[i], np.linalg.solve(m + 0.5 * np.eye(k), b), rtol=1e-10)
    bad = dict(rows[0])
    for p in range(k):
        for q in range(p, k):
            bad[f"ata_{p}_{q}"] = 0.0
    with pytest.raises(solve.NotPositiveDefinite):
        solve.solve_batch(pd.DataFrame([bad]), k, 0.0)


def test_ridge_solve_spark_matches_numpy(spark):
    k = 2
    ne = spark.createDataFrame([(7, 4.0, 1.0, 3.0, 1.0, 2.0)], "key long, ata_0_0 double, ata_0_1 double, ata_1_1 double, atb_0 double, atb_1 double")
    x = solve.ridge_solve(ne, k, 1.0).first().x
    np.testing.assert_allclose(x, np.linalg.solve([[5.0, 1.0], [1.0, 4.0]], [1.0, 2.0]))


def test_denormalise_ranges(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 62, 1.0), (0, 63, 1.0), (0, 5000, 2.0)], "i0 long, i1 long, yhat double")
    got = [r.yhat for r in predict.denormalise(df, predict.REFERENCE_RESCALE_BREAKS, predict.REFERENCE_RESCALE_ELSE).orderBy("i1").collect()]
    assert got == [301894.0, 301894.0, 301895.0, 2 * 100532.0]


def test_predict_and_losses(spark):
    t = _tensor(spark, [(0, 0, 1.0), (1, 1, 2.0)], (2, 2))
    f0 = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0])], "idx long, v array<double>")
    f1 = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 3.0])], "idx long, v array<double>")
    p = {r.i0: r.yhat for r in predict.predict(spark, t, {0: f0, 1: f1}, 2).collect()}
    assert p == {0: 3.0, 1: 1.0}
    row = predict.squared_error(spark, t, {0: f0, 1: f1}, 2).first()
    assert row.sse == pytest.approx(4.0 + 1.0) and row.n == 2
    assert predict.training_loss(5.0, 2, "wls") == 2.5 and predict.rmse(8.0, 2) == 2.0
    assert predict.mean_loss([1.0, 2.0], [0.0, 0.0], "wls") == pytest.approx(2.5)
    ml = predict.mean_loss_df(f0, f1, 2).first().mean_loss
    assert ml == pytest.approx((0.75 - 1.5) ** 2 + (1.0 - 2.0) ** 2)


def test_update_independent_of_partitions(spark, sf):
    from twinfold.plans.catalog import x1, lcg_factors
    a = x1(spark, sf)
    f = lcg_factors(spark, a, 0, 3)
    base = {r.idx: list(r.v) for r in update.update_uncoupled(spark, a, f, 0, 3, Options(0.1), 0).collect()}
    a2 = a.with_entries(a.entries.repartition(5))
    f2 = {m: df.repartition(3) for m, df in f.items()}
    other = {r.idx: list(r.v) for r in update.update_uncoupled(spark, a2, f2, 0, 3, Options(0.1), 0).collect()}
    for k in base:
        np.testing.assert_allclose(base[k], other[k], rtol=1e-9)


def test_update_lowers_block_objective(spark, sf):
    """The specific-block update minimises its own ridge objective (property)."""
    from twinfold.plans.catalog import x1, lcg_factors
    a = x1(spark, sf)
    rank, common, lam = 3, 1, 0.1
    f = lcg_factors(spark, a, 0, rank)
    new = update.update_specific(spark, a, f, 1, rank, common, Options(lam), 0)

    def objective(f1):
        j = fo.join_factors(spark, a.entries, {0: f[0], 1: f1}, a.dims, [0, 1], rank)
        yhat = sum(F.col("f0")[r] * F.col("f1")[r] for r in range(rank))
        sse = j.agg(F.sum((F.col("y") - yhat) ** 2)).first()[0]
        reg = f1.agg(F.sum(sum(F.col("v")[r] ** 2 for r in range(common, rank)))).first()[0]
        return sse + lam * reg

    assert objective(new) <= objective(f[1]) + 1e-9


def test_gradient_vanishes_at_solution(spark, sf):
    """After a full-rank update without mean pull, gradient + 2 lam x = 0 per observed key."""
    from twinfold.plans.catalog import x1, lcg_factors
    a = x1(spark, sf)
    rank, lam = 2, 0.3
    f = lcg_factors(spark, a, 0, rank)
    new = update.update_uncoupled(spark, a, f, 0, rank, Options(lam), 0)
    g = {r.key: [r.g_0, r.g_1] for r in normal.gradient_by_key(spark, a, {0: new, 1: f[1]}, 0, rank).collect()}
    x = {r.idx: list(r.v) for r in new.collect()}
    for k, gv in g.items():
        np.testing.assert_allclose(np.array(gv) + 2 * lam * np.array(x[k]), 0.0, atol=1e-7)


def test_stop_and_options_parse():
    s = Stop.parse("0_0.0001_1_20_2_3")
    assert (s.min_rel_decrease, s.max_iter, s.max_hours) == (0.0001, 20, 3.0)
    assert Options.parse("CF_0.1_WLS") == Options(0.1, "wls")
    with pytest.raises(ValueError):
        Stop()
    with pytest.raises(ValueError):
        Options.parse("GD_0.1_LS")
