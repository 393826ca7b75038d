import numpy as np
import pytest

import numpy_model as nm
from twinfold.operators.factors import column_means, init_factor
from twinfold.operators.predict import mean_loss, squared_error
from twinfold.plans.fit import FactorStore, LEAST_ERROR, evaluate, fit
from twinfold.sources import tpch
from twinfold.spec import FitConfig, Options, Stop


def _np_inputs(spark, tensors, rank, init="lcg"):
    arrs = []
    for t in tensors:
        pdf = t.entries.toPandas()
        idx = pdf[[f"i{m}" for m in range(t.n_modes)]].to_numpy().astype(np.int64)
        arrs.append((idx, pdf["y"].to_numpy()))
    F = {}
    for ti, t in enumerate(tensors):
        for m, d in enumerate(t.dims):
            pdf = init_factor(spark, d, rank, init, ti, m).toPandas().sort_values("idx")
            F[(ti, m)] = np.stack(pdf["v"].to_numpy())
    return arrs, F


def _model_factors(model):
    out = {}
    for (t, m) in model.paths:
        pdf = model.factor(t, m).toPandas().sort_values("idx")
        out[(t, m)] = np.stack(pdf["v"].to_numpy())
    return out


@pytest.mark.parametrize("rank,common,loss", [(5, 3, "ls"), (4, 0, "ls"), (3, 3, "wls"), (4, 2, "wls")])
def test_fit_matches_numpy(spark, sf, rank, common, loss):
    tensors, _, coup = tpch.coupled_pair(spark, sf, with_validation=False)
    sweeps = 2
    cfg = FitConfig(rank=rank, common=common, options=Options(0.1, loss), stop=Stop(max_iter=sweeps), init="lcg")
    model = fit(spark, tensors, coup, cfg)
    arrs, F = _np_inputs(spark, tensors, rank)
    losses = []
    for _ in range(sweeps):
        nm.sweep(arrs, F, 1, rank, common, 0.1, loss)
        losses.append(nm.total_loss(arrs, F, 1, rank, loss))
    got = _model_factors(model)
    assert model.final_iter == sweeps
    for k in F:
        np.testing.assert_allclose(got[k], F[k], rtol=1e-7, atol=1e-8)
    hist = {(i, term): v for i, _, term, v in model.history}
    se, ml = losses[-1]
    assert hist[(sweeps, "se_0")] == pytest.approx(se[0], rel=1e-8)
    assert hist[(sweeps, "se_1")] == pytest.approx(se[1], rel=1e-8)
    assert hist[(sweeps, "mean")] == pytest.approx(ml, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("method", ["sum", "gram"])
def test_three_mode_fit_matches_numpy(spark, sf, method):
    tensors, _, coup = tpch.coupled_pair(spark, sf, three_mode=True, with_validation=False)
    rank, common = 4, 2
    cfg = FitConfig(rank=rank, common=common, options=Options(0.5, "ls"), stop=Stop(max_iter=1), init="lcg",
                    method=method)
    model = fit(spark, tensors, coup, cfg)
    arrs, F = _np_inputs(spark, tensors, rank)
    nm.sweep(arrs, F, 1, rank, common, 0.5, "ls")
    got = _model_factors(model)
    for k in F:
        np.testing.assert_allclose(got[k], F[k], rtol=1e-7, atol=1e-8)


def test_loss_falls_and_validation_tracked(spark, sf):
    tensors, valid, coup = tpch.coupled_pair(spark, sf)
    cfg = FitConfig(rank=3, common=1, options=Options(0.1, "ls"), stop=Stop(min_rel_decrease=1e-3, max_iter=3))
    model = fit(spark, tensors, coup, cfg, validation=valid)
    totals = [v for _, _, term, v in model.history if term == "total"]
    assert totals[1] < totals[0]
    assert set(model.best_validation) == {0, 1}
    m = model.metrics.toPandas()
    assert {"se_0", "se_1", "mean", "total", "val_rmse_0", "val_rmse_1"} <= set(m.term)
    assert model.best_factor_table(0).count() == sum(tensors[0].dims)


def test_refuses_single_tensor(spark, sf):
    tensors, _, coup = tpch.coupled_pair(spark, sf, with_validation=False)
    with pytest.raises(ValueError):
        fit(spark, tensors[:1], coup, FitConfig(rank=2, common=1, stop=Stop(max_iter=1)))


def test_versions_are_kept_only_where_needed_and_reruns_start_the_log_anew(spark, sf, tmp_path):
    import os

    def versions(root):
        return {os.path.join(d, x) for d, _, files in os.walk(root) for x in files if x.endswith(".parquet")}

    tensors, valid, coup = tpch.coupled_pair(spark, sf)
    metrics = str(tmp_path / "metrics")
    seen = {}
    for keep, iters in (("all", 3), ("needed", 2)):
        cfg = FitConfig(rank=2, common=1, stop=Stop(max_iter=iters), init="lcg", checkpoint_every=100, keep_versions=keep)
        root = str(tmp_path / keep)
        model = fit(spark, tensors, coup, cfg, validation=valid, root=root, metrics_path=metrics)
        seen[keep] = len({os.path.dirname(v) for v in versions(root)})
        assert model.factor_table().count() == sum(sum(t.dims) for t in tensors)
        for t in range(2):
            assert model.best_factor_table(t).count() == sum(tensors[t].dims)
        assert {r.iter for r in spark.read.parquet(metrics).select("iter").distinct().collect()} == set(range(iters + 1))
    assert seen["needed"] < seen["all"]


def test_partitions_follow_bytes_or_split(spark):
    from twinfold.operators.tensor import partitions_for

    cores = spark.sparkContext.defaultParallelism
    assert partitions_for(spark, 10, 2, 1 << 20) == cores
    assert partitions_for(spark, 10**6, 2, 24_000) == 1000
    assert partitions_for(spark, 10**6, 2, 24_000, split=48, dim=154) == 48
    assert partitions_for(spark, 10**6, 2, 24_000, split=48, dim=12) == 12


@pytest.mark.parametrize("common,loss,method", [(2, "ls", "sum"), (2, "wls", "gram"), (0, "ls", "sum"), (3, "ls", "sum")])
def test_losses_of_the_writes_are_those_of_the_written_tables(spark, sf, common, loss, method):
    tensors, valid, coup = tpch.coupled_pair(spark, sf)
    cfg = FitConfig(rank=3, common=common, options=Options(0.1, loss), stop=Stop(max_iter=2), init="lcg", method=method)
    model = fit(spark, tensors, coup, cfg, validation=valid)
    log = {(i, term): v for i, _, term, v in model.history}
    for it, paths in model.versions.items():
        factors = {k: spark.read.parquet(p) for k, p in paths.items()}
        assert all(f.columns == ["idx", "v"] for f in factors.values())
        means = {k: list(column_means(f, 3).first()) for k, f in factors.items()}
        assert log[(it, "mean")] == pytest.approx(mean_loss(means[(0, 0)], means[(1, 0)], loss), rel=1e-9, abs=1e-15)
        for t, ten in enumerate(tensors):
            row = squared_error(spark, ten, {m: factors[(t, m)] for m in range(2)}, 3).first()
            assert log[(it, f"se_{t}")] == pytest.approx(row.sse / (row.n if loss == "wls" else 1), rel=1e-8)


def test_means_and_errors_need_no_job_and_lost_digits_are_read_again(spark, sf, tmp_path):
    ten = tpch.coupled_pair(spark, sf, with_validation=False)[0][0]
    store = FactorStore(spark, str(tmp_path), 2)
    store.put_many({(0, m): init_factor(spark, d, 2, "lcg", 0, m) for m, d in enumerate(ten.dims)}, "a")
    last = store.frames[(0, 1)]
    store.put((0, 1), last.selectExpr("idx", "v", "CASE WHEN idx = 0 THEN 5D END AS sse"), "b")
    for m in range(2):
        assert store.means[(0, m)] == pytest.approx(list(column_means(store.frames[(0, m)], 2).first()), rel=1e-12)
    true = squared_error(spark, ten, {m: store.frames[(0, m)] for m in range(2)}, 2).first()

    def jobs_of(squares):
        group = f"evaluate-{squares}"
        spark.sparkContext.setJobGroup(group, group)
        out = evaluate(spark, [ten], None, store, 2, None, {0: (0, 1)}, [true.n], [squares])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (means, train, val), jobs = jobs_of(4.9 / LEAST_ERROR)
    assert jobs == 0 and train == {0: (5.0, true.n)} and val == {} and means == store.means
    (_, train, _), jobs = jobs_of(5.1 / LEAST_ERROR)
    assert jobs > 0 and train[0] == (pytest.approx(true.sse, rel=1e-12), true.n)
