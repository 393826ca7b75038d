import glob

import pytest

from twinfold.operators.factors import init_factor
from twinfold.plans.fit import fit
from twinfold.sources import sinks, tpch
from twinfold.spec import FitConfig, Options, Stop


def test_factor_text_is_in_index_order(spark, scratch):
    f = init_factor(spark, 257, 3, "lcg", 0, 1, partitions=7)
    sinks.export_factor_text(f, 3, f"{scratch}/U")
    lines = []
    for p in sorted(glob.glob(f"{scratch}/U/part-*")):
        lines += open(p).read().splitlines()
    rows = {r.idx: r.v for r in f.collect()}
    assert len(lines) == 257
    for i, line in enumerate(lines):
        assert [float(x) for x in line.split("\t")] == pytest.approx(list(rows[i]), rel=0, abs=0)


def test_checkpoint_schedule_and_logs(spark, sf, scratch):
    tensors, valid, coup = tpch.coupled_pair(spark, sf)
    cfg = FitConfig(rank=2, common=1, options=Options(0.1), stop=Stop(max_iter=3), checkpoint_every=2)
    model = fit(spark, tensors, coup, cfg, validation=valid)
    totals = {i: v for i, _, t, v in model.history if t == "total"}
    expected = {0, 2} | ({3} if totals[3] < totals[2] else set())
    assert set(model.checkpoints) == expected
    sinks.write_validation_log(model.metrics, 2, f"{scratch}/vlog")
    vlog = spark.read.option("sep", "\t").option("header", "true").csv(f"{scratch}/vlog")
    assert vlog.columns == ["iter", "val_rmse_0", "val_rmse_1"] and vlog.count() == 4
    best_iter, best_rmse, _ = model.best_validation[0]
    rmses = {i: v for i, _, t, v in model.history if t == "val_rmse_0"}
    assert best_rmse == min(rmses.values()) and rmses[best_iter] == best_rmse
