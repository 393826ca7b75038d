import numpy as np
import pytest

import numpy_model as nm
from test_fit import _model_factors, _np_inputs
from twinfold.operators import update
from twinfold.operators import factors as fo
from twinfold.operators import normal, predict
from twinfold.operators.gram import merge_and_solve, partial_grams, running_sums
from twinfold.plans.catalog import lcg_factors, x1, x2
from twinfold.plans.fit import fit
from twinfold.sources import tpch
from twinfold.spec import FitConfig, Options, Stop, Tensor


def _rows(df):
    return {r.idx: np.array(r.v) for r in df.collect()}


def test_running_sums_hold_one_row_per_key():
    one = np.ones((3, 2))
    batches = [(np.array([1, 1, 2]), one), (np.array([2, 2, 3]), one), (np.array([3, 4, 4]), one)]
    out = [(k.tolist(), v[:, 0].tolist()) for k, v in running_sums(iter(batches))]
    assert [k for ks, _ in out for k in ks] == [1, 2, 3, 4] and [x for _, v in out for x in v] == [2, 3, 2, 2]
    with pytest.raises(ValueError):
        list(running_sums(iter([(np.array([2, 1]), np.ones((2, 1)))])))


def test_a_key_over_many_batches_is_carried_as_one_row():
    """One key in 200 batches: what is held never grows, and nothing is emitted before the key ends."""
    import time

    seconds = []
    for n in (100, 400):
        start = time.perf_counter()
        out = list(running_sums((np.zeros(2000, np.int64), np.ones((2000, 300))) for _ in range(n)))
        seconds.append(time.perf_counter() - start)
        assert len(out) == 1 and out[0][1].shape == (1, 300) and out[0][1][0, 0] == 2000 * n
    assert seconds[1] < 12 * seconds[0]


def _keyed(rows):
    return {(r.asDict().get("tensor"), r.idx): np.array(r.v) for r in rows}


def test_two_step_merge_equals_one_step(spark, sf):
    a = x1(spark, sf)
    f = lcg_factors(spark, a, 0, 3)
    partial = partial_grams(normal.observations(spark, a, f, 0, [0, 1, 2], 3), 3)
    one, two = (_keyed(merge_and_solve([partial], [f[0]], 3, 3, 0, 0.1, [1.0], slots=s).collect()) for s in (0, 3))
    assert one.keys() == two.keys()
    for k in one:
        np.testing.assert_allclose(one[k], two[k], rtol=1e-9, atol=1e-12)


BAD = {
    "nan": [(0, [1.0, 0.5]), (1, [float("nan"), 0.5]), (2, [0.2, 0.3])],
    "null cell": [(0, [1.0, 0.5]), (1, [None, 0.5]), (2, [0.2, 0.3])],
    "missing": [(0, [1.0, 0.5]), (2, [0.2, 0.3])],
}


def _paths(spark):
    """(method, broadcast threshold) of the sum and gram paths over broadcast and shuffle joins."""
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return [("sum", default), ("gram", default), ("sum", "-1"), ("gram", "-1")]


@pytest.mark.parametrize("fault", sorted(BAD))
@pytest.mark.parametrize("bad_mode", [0, 1])
def test_every_path_refuses_the_same_factors(spark, fault, bad_mode):
    entries = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0), (1, 0, 0.5)], "i0 long, i1 long, y double")
    t = Tensor(entries, (3, 3), "t")
    schema = "idx long, v array<double>"
    good = spark.createDataFrame([(i, [0.3 + i, 0.7]) for i in range(3)], schema)
    f = {0: good, 1: good}
    f[bad_mode] = spark.createDataFrame(BAD[fault], schema)
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for method, threshold in _paths(spark):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            runs = [update.update_uncoupled(spark, t, f, 0, 2, Options(0.1), 4, method=method),
                    update.update_specific(spark, t, f, 0, 2, 1, Options(0.1), 4, method=method),
                    update.update_common(spark, t, f, 0, 4, t, {0: good, 1: good}, 0, 4, 2, 1, Options(0.1), method=method)]
            for df in runs:
                with pytest.raises(Exception, match="no finite factor row"):
                    df.collect()
            for df in (predict.predict(spark, t, f, 2), predict.squared_error(spark, t, f, 2),
                       normal.gradient_by_key(spark, t, f, 0, 2)):
                with pytest.raises(Exception, match="no finite factor row"):
                    df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)


def test_every_path_refuses_indices_without_a_row(spark):
    entries = spark.createDataFrame([(0, 0, 1.0), (5, 1, 2.0), (2, 9, 3.0)], "i0 long, i1 long, y double")
    t = Tensor(entries, (3, 3), "t")
    good = spark.createDataFrame([(i, [0.3 + i, 0.7]) for i in range(3)], "idx long, v array<double>")
    for method in ("sum", "gram"):
        with pytest.raises(Exception, match="no finite factor row"):
            update.update_uncoupled(spark, t, {0: good, 1: good}, 0, 2, Options(0.1), 3, method=method).collect()
    with pytest.raises(Exception, match="no finite factor row for index (5 of mode 0|9 of mode 1)"):
        predict.predict(spark, t, {0: good, 1: good}, 2).collect()


def test_equations_that_are_not_finite_fail(spark):
    entries = spark.createDataFrame([(0, 0, float("nan")), (1, 1, 2.0)], "i0 long, i1 long, y double")
    t = Tensor(entries, (2, 2), "t")
    good = spark.createDataFrame([(i, [0.3 + i, 0.7]) for i in range(2)], "idx long, v array<double>")
    for method in ("sum", "gram"):
        with pytest.raises(Exception, match="not finite for keys \\[0\\]"):
            update.update_uncoupled(spark, t, {0: good, 1: good}, 0, 2, Options(0.1), 2, method=method).collect()


def test_salted_shuffle_join_keeps_rows(spark, sf, monkeypatch):
    """Heavy indices spread over salts give the rows of the broadcast join."""
    a = x1(spark, sf)
    f = lcg_factors(spark, a, 0, 3)
    want = _rows(update.update_uncoupled(spark, a, f, 1, 3, Options(0.1), 0))
    errors = predict.squared_error(spark, a, f, 3).first()
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        heavy = {m: fo.heavy_indices(a.entries, m, rows=3).cache() for m in range(2)}
        assert heavy[1].agg({"salts": "max"}).first()[0] > 1
        for method in ("sum", "gram"):
            got = _rows(update.update_uncoupled(spark, a, f, 1, 3, Options(0.1), 0, method=method, heavy=heavy))
            assert got.keys() == want.keys()
            for k in want:
                np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-12)
        salted = predict.squared_error(spark, a, f, 3, heavy).first()
        assert salted.n == errors.n and salted.sse == pytest.approx(errors.sse, rel=1e-12)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)


@pytest.mark.parametrize("loss", ["ls", "wls"])
def test_gram_matches_sum_path(spark, sf, loss):
    a, b = x1(spark, sf), x2(spark, sf)
    rank = 4
    o = Options(0.2, loss)
    fa, fb = lcg_factors(spark, a, 0, rank), lcg_factors(spark, b, 1, rank)
    own, other = [0.4, 0.5, 0.6, 0.3], [0.5, 0.5, 0.2, 0.7]
    for method_pair in [("sum", "gram")]:
        s = _rows(update.update_uncoupled(spark, a, fa, 0, rank, o, 100, own, other, method="sum"))
        g = _rows(update.update_uncoupled(spark, a, fa, 0, rank, o, 100, own, other, method="gram"))
        assert s.keys() == g.keys()
        for k in s:
            np.testing.assert_allclose(s[k], g[k], rtol=1e-9, atol=1e-12)
        s = _rows(update.update_specific(spark, a, fa, 1, rank, 1, o, 100, method="sum"))
        g = _rows(update.update_specific(spark, a, fa, 1, rank, 1, o, 100, method="gram"))
        for k in s:
            np.testing.assert_allclose(s[k], g[k], rtol=1e-9, atol=1e-12)
        s = update.update_common(spark, a, fa, 1, 100, b, fb, 1, 50, rank, 2, o, method="sum").collect()
        g = update.update_common(spark, a, fa, 1, 100, b, fb, 1, 50, rank, 2, o, method="gram").collect()
        sd = {(r.tensor, r.idx): np.array(r.v) for r in s}
        gd = {(r.tensor, r.idx): np.array(r.v) for r in g}
        assert sd.keys() == gd.keys()
        for k in sd:
            np.testing.assert_allclose(sd[k], gd[k], rtol=1e-9, atol=1e-12)


def test_fit_rank_10_uses_gram_and_matches_numpy(spark, sf):
    tensors, _, coup = tpch.coupled_pair(spark, sf, with_validation=False)
    rank, common = 10, 9
    cfg = FitConfig(rank=rank, common=common, options=Options(0.3, "ls"), stop=Stop(max_iter=1), init="lcg")
    model = fit(spark, tensors, coup, cfg)
    arrs, F = _np_inputs(spark, tensors, rank)
    nm.sweep(arrs, F, 1, rank, common, 0.3, "ls")
    got = _model_factors(model)
    for k in F:
        np.testing.assert_allclose(got[k], F[k], rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("rank,common,loss", [(5, 3, "ls"), (4, 2, "wls")])
def test_shuffle_join_fit_matches_numpy(spark, sf, rank, common, loss):
    """Factors above the broadcast bound (salted shuffle joins) give the same sweep."""
    tensors, _, coup = tpch.coupled_pair(spark, sf, with_validation=False)
    cfg = FitConfig(rank=rank, common=common, options=Options(0.2, loss), stop=Stop(max_iter=2), init="lcg", split=5,
                    storage="DISK_ONLY")
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = fit(spark, tensors, coup, cfg)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
    arrs, F = _np_inputs(spark, tensors, rank)
    for _ in range(2):
        nm.sweep(arrs, F, 1, rank, common, 0.2, loss)
    got = _model_factors(model)
    for k in F:
        np.testing.assert_allclose(got[k], F[k], rtol=1e-7, atol=1e-9)
    se, _ = nm.total_loss(arrs, F, 1, rank, loss)
    hist = {(i, term): v for i, _, term, v in model.history}
    assert hist[(2, "se_0")] == pytest.approx(se[0], rel=1e-8)
    assert hist[(2, "se_1")] == pytest.approx(se[1], rel=1e-8)
