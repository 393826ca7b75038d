import os

import pytest

from twinfold.plans import commits
from twinfold.plans.fit import fit
from twinfold.sources import tpch
from twinfold.spec import FitConfig, Options, Stop


def _run(spark, sf, root, sweeps, resume=False, **kw):
    tensors, valid, coup = tpch.coupled_pair(spark, sf)
    options = kw.pop("options", Options(0.1, "ls"))
    cfg = FitConfig(rank=3, common=1, options=options, stop=Stop(max_iter=sweeps), init="lcg")
    return fit(spark, tensors, coup, cfg, validation=valid, root=str(root), resume=resume, **kw)


def _rows(table):
    return {(r.tensor, r.mode, r.idx): list(r.v) for r in table.collect()}


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12)


def _log(model):
    return {(i, term): v for i, _, term, v in model.history}


def test_two_and_two_sweeps_are_four(spark, sf, tmp_path):
    whole = _run(spark, sf, tmp_path / "whole", 4, metrics_path=str(tmp_path / "m4"))
    _run(spark, sf, tmp_path / "half", 2, metrics_path=str(tmp_path / "m2"))
    # What a run killed in its third sweep leaves: a factor version cut short, and a commit that was not renamed into place.
    state = commits.latest(spark, str(tmp_path / "half"), commits.table(spark, str(tmp_path / "half")).first().fit)
    assert state.it == 2
    for name in (f"factors/it00003/v{state.version + 1:05d}_t0_m0", f"factors/it00003/v{state.version + 2:05d}", "commits/it=3/_temporary/0"):
        os.makedirs(tmp_path / "half" / name)
        (tmp_path / "half" / name / "part-00000-cut.snappy.parquet").write_bytes(b"PAR1 cut short")
    went_on = _run(spark, sf, tmp_path / "half", 4, resume=True, metrics_path=str(tmp_path / "m2"))
    _same(_rows(went_on.factor_table()), _rows(whole.factor_table()))
    assert went_on.final_iter == whole.final_iter and went_on.checkpoints.keys() == whole.checkpoints.keys()
    a, b = _log(went_on), _log(whole)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a)
    for t in range(2):
        assert went_on.best_validation[t][0] == whole.best_validation[t][0]
        _same(_rows(went_on.best_factor_table(t)), _rows(whole.best_factor_table(t)))
    for it in whole.checkpoints:
        _same(_rows(went_on.factor_table(went_on.checkpoints[it])), _rows(whole.factor_table(whole.checkpoints[it])))
    logged = [spark.read.parquet(str(tmp_path / m)).count() for m in ("m2", "m4")]
    assert logged[0] == logged[1] == len(whole.history)
    # Nothing is left to do: the committed model comes back without a sweep.
    again = _run(spark, sf, tmp_path / "half", 4, resume=True)
    assert [p for p, _ in again.timings if p.startswith("sweep")] == []
    _same(_rows(again.factor_table()), _rows(whole.factor_table()))


def test_resume_refuses_another_fit_and_starts_where_nothing_is_committed(spark, sf, tmp_path):
    first = _run(spark, sf, tmp_path / "new", 1, resume=True)
    assert first.final_iter == 1
    with pytest.raises(ValueError, match="another one"):
        _run(spark, sf, tmp_path / "new", 2, resume=True, options=Options(0.2, "ls"))
    with pytest.raises(ValueError, match="root"):
        tensors, _, coup = tpch.coupled_pair(spark, sf, with_validation=False)
        fit(spark, tensors, coup, FitConfig(rank=2, common=1, stop=Stop(max_iter=1)), resume=True)
    # Without resume the same root starts anew.
    assert {r.iter for r in commits.table(spark, str(tmp_path / "new")).collect()} == {0, 1}
    _run(spark, sf, tmp_path / "new", 1)
    assert sorted(r.iter for r in commits.table(spark, str(tmp_path / "new")).collect()) == [0, 1]


def test_state_reads_back_as_written(spark, tmp_path):
    state = commits.State(0, 1.5, float("nan"), float("-inf"), 7, {(0, 1): [0.1, 1 / 3]}, [(0, 0.1, "total", float("inf"))],
                          {2: {(0, 0): "a"}, 3: {(0, 0): "b"}}, {0: {(0, 0): "c"}}, {1: (2, 0.25, {(1, 0): "d"})}, ["a", "b"])
    commits.commit(spark, str(tmp_path), "x", state)
    assert repr(commits.latest(spark, str(tmp_path), "x")) == repr(state)
    assert commits.latest(spark, str(tmp_path / "none"), "x") is None
