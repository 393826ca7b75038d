"""Sums of a mode kept between updates, and the stored entries a resumed fit takes up again."""

import os

import pytest

from test_plans import _above, _plan
from twinfold.operators import factors as fo
from twinfold.operators import normal, predict, tensor, update
from twinfold.operators.factors import init_factor
from twinfold.plans import fit as fitting
from twinfold.spec import Coupling, FitConfig, Options, Stop, Tensor


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.twinfold.maxBroadcastBytes", "0")
    yield
    spark.conf.unset("spark.twinfold.maxBroadcastBytes")


def _tensor(spark, dims=(40, 30), seed=1, hot=True, name="t"):
    """Entries of which (``hot``) a third lie on index 7 of mode 1; index 3 of mode 0 has none."""
    e = spark.range(900).selectExpr(f"IF((id * 7) % {dims[0]} = 3, 4L, (id * 7) % {dims[0]}) AS i0",
                                    f"IF({'id % 3 = 0' if hot else 'false'}, 7L, (id * 11 + id div 40) % {dims[1]}) AS i1",
                                    f"CAST((id * {seed + 4}) % 11 AS DOUBLE) AS y")
    return Tensor(e, dims, name)


def _factors(spark, t, rank, ti=0):
    return {m: init_factor(spark, d, rank, "lcg", ti, m) for m, d in enumerate(t.dims)}


def _rows(df):
    return {tuple(r[c] for c in df.columns if c not in ("v", "sse")): [*r.v, *([r.sse or 0.0] if "sse" in df.columns else [])] for r in df.collect()}


def _same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-8), k


@pytest.mark.parametrize("loss", ["ls", "wls"])
def test_updates_and_errors_of_sums_are_those_of_the_entries(spark, loss):
    a, b = _tensor(spark), _tensor(spark, (25, 30), 5)
    b = b.with_entries(b.entries.where("i1 <> 11"))
    fa, fb = _factors(spark, a, 4), _factors(spark, b, 4, 1)
    o, n = Options(0.1, loss), 900
    sums = {(t, m): normal.mode_sums(spark, ten, f, m, 4).persist() for t, (ten, f) in enumerate(((a, fa), (b, fb))) for m in range(2)}
    assert sums[(0, 0)].columns == ["key", "n", *normal.sum_names(4)]
    pull = [0.3, 0.1, 0.7, 0.2], [0.5, 0.6, 0.2, 0.9]
    for build in (lambda s: update.update_uncoupled(spark, a, fa, 0, 4, o, n, *pull, with_error=True, sums=s and s[(0, 0)]),
                  lambda s: update.update_specific(spark, a, fa, 1, 4, 1, o, n, with_error=True, sums=s and s[(0, 1)]),
                  lambda s: update.update_specific(spark, a, fa, 1, 4, 0, o, n, with_error=True, sums=s and s[(0, 1)])):
        df = build(sums)
        _same(_rows(df), _rows(build(None)))
        assert "Range (0, 900" not in _plan(df).split("InMemoryRelation")[0]
    for common in (2, 4):
        def shared(s):
            sides = [update.Side(t, f, 1, n, (i, 1), None, s and s[(i, 1)]) for i, (t, f) in enumerate(((a, fa), (b, fb)))]
            return update.update_shared(spark, sides, 4, common, o)
        _same(_rows(shared(sums)), _rows(shared(None)))
    want = predict.squared_error(spark, a, fa, 4).first()
    for m in range(2):
        got = predict.squared_error(spark, a, fa, 4, sums=(m, sums[(0, m)])).first()
        assert got.n == want.n == 900 and got.sse == pytest.approx(want.sse, rel=1e-10)
    for df in sums.values():
        df.unpersist()


@pytest.mark.parametrize("fault", ["missing", "twice", "nan"])
def test_faults_are_refused_from_sums_too(spark, fault):
    t = _tensor(spark)
    f = _factors(spark, t, 2)
    sums = {m: normal.mode_sums(spark, t, f, m, 2) for m in range(2)}
    bad = {"missing": f[1].where("idx <> 7"), "twice": f[1].unionByName(f[1].where("idx = 7")),
           "nan": f[1].selectExpr("idx", "IF(idx = 7, array(double('NaN'), 1D), v) AS v")}[fault]
    own = {0: f[0], 1: bad}
    side = update.Side(t, own, 1, 900, (0, 1), None, sums[1])
    for build in (lambda: update.update_specific(spark, t, own, 1, 2, 1, Options(0.1), 900, sums=sums[1]),
                  lambda: update.update_uncoupled(spark, t, own, 1, 2, Options(0.1), 900, sums=sums[1]),
                  lambda: update.update_shared(spark, [side, side._replace(label=(1, 1))], 2, 1, Options(0.1)),
                  lambda: predict.squared_error(spark, t, own, 2, sums=(1, sums[1]))):
        with pytest.raises(Exception, match="key 7"):
            build().collect()


def test_unsorted_copies_are_neither_sorted_nor_moved_to_meet_a_factor(spark, no_broadcast, tmp_path):
    t = _tensor(spark)
    f = _factors(spark, t, 3)
    for rows in (20, 10**6):
        hot = {m: fo.heavy_table(spark, [(r.idx, r.salts) for r in fo.heavy_indices(t.entries, m, rows).collect()]) for m in range(2)}
        assert fo.none_heavy(hot[1]) == (rows > 900)
        open_files = spark.conf.get(fo.OPEN_FILES)
        stored = fo.store_entries(spark, t.entries, 1, 2, hot[1], 6, f"dealt_{rows}", f"{tmp_path}/it's {rows}", sort=False)
        assert spark.conf.get(fo.OPEN_FILES) == open_files
        again = fo.stored_table(spark, 1, 2, 6, f"again_{rows}", f"{tmp_path}/it's {rows}")
        for e in (stored, again):
            df = normal.mode_sums(spark, t.with_entries(e), f, 0, 3, hot)
            chains = list(_above(_plan(df), "Bucketed: true"))
            assert chains
            for chain in chains:
                joined = next(i for i, line in enumerate(chain) if "ShuffledHashJoin" in line)
                assert not [line for line in chain[:joined] if "Exchange" in line or "Sort" in line]
                # To the key; where heavy keys are spread over salts, their sums once more.
                assert len([line for line in chain if "Exchange" in line]) == (2 if rows == 20 else 1)
            got = {r.key: tuple(r)[1:] for r in df.collect()}
            want = {r.key: tuple(r)[1:] for r in normal.mode_sums(spark, t, f, 0, 3).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
        for name in ("dealt", "again"):
            spark.sql(f"DROP TABLE {name}_{rows}")


def test_buckets_bound_what_a_task_hashes():
    assert fo.buckets_for_hashing(10, 2) == 1
    assert fo.buckets_for_hashing(10**8, 2) * fo.HASHED_BYTES >= 10**8 * (16 + fo.HASHED_ROW)


def test_digests_tell_entries_apart_whatever_their_order(spark):
    t = _tensor(spark)
    n, squares, digest = tensor.check_and_digest(t)
    assert (n, squares) == tensor.check_and_sum(t)
    assert tensor.check_and_digest(t.with_entries(t.entries.repartition(5, "y")))[2] == digest
    other = t.entries.withColumn("y", t.entries["i0"] * 0 + 1.0)
    assert tensor.check_and_digest(t.with_entries(other))[2] != digest
    assert tensor.check_and_digest(t.with_entries(t.entries.where("false")))[2] == "0_0_0"


def _pair(spark, seed=1):
    return [_tensor(spark, seed=seed, name="a"), _tensor(spark, (25, 30), seed + 4, hot=False, name="b")], [Coupling(0, 1, 1, 1)]


def _fit(spark, root, sweeps, resume=False, seed=1, common=1):
    tensors, coup = _pair(spark, seed)
    cfg = FitConfig(rank=2, common=common, stop=Stop(max_iter=sweeps), init="lcg")
    return fitting.fit(spark, tensors, coup, cfg, root=str(root), resume=resume)


def _log(model):
    return {(i, term): v for i, _, term, v in model.history}


def _passes(monkeypatch):
    taken = []
    of_entries = normal.observations

    def counted(spark, t, factors, mode, *args, **kw):
        taken.append((t.name, mode))
        return of_entries(spark, t, factors, mode, *args, **kw)

    monkeypatch.setattr(normal, "observations", counted)
    monkeypatch.setattr(update, "observations", counted)
    return taken


@pytest.mark.parametrize("common", [1, 2])
def test_entries_move_once_per_mode_and_sweep(spark, tmp_path, monkeypatch, common):
    want = _fit(spark, tmp_path / "broadcast", 2, common=common)
    spark.conf.set("spark.twinfold.maxBroadcastBytes", "0")
    try:
        taken = _passes(monkeypatch)
        got = _fit(spark, tmp_path / "large", 2, common=common)
    finally:
        spark.conf.unset("spark.twinfold.maxBroadcastBytes")
    # One for each of four modes and two sweeps, and the first loss, which the first update or the next one takes again.
    assert len(taken) <= 9
    _same(_rows(got.factor_table()), _rows(want.factor_table()))
    a, b = _log(got), _log(want)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-8, abs=1e-10) for k in b)
    # Sums that no later update can use are deleted.
    assert len(os.listdir(tmp_path / "large" / "sums")) <= 4


def test_resumed_fit_takes_the_stored_entries_and_sums(spark, no_broadcast, tmp_path, monkeypatch):
    whole = _fit(spark, tmp_path / "whole", 2)
    _fit(spark, tmp_path / "half", 1)
    stored = sorted(os.listdir(tmp_path / "half" / "entries"))
    assert len(stored) == 4
    taken = _passes(monkeypatch)
    went_on = _fit(spark, tmp_path / "half", 2, resume=True)
    assert sorted(os.listdir(tmp_path / "half" / "entries")) == stored
    # b's parts were summed for the last update of the first sweep, and its other factor has not changed since.
    assert sorted(taken) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    _same(_rows(went_on.factor_table()), _rows(whole.factor_table()))
    a, b = _log(went_on), _log(whole)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in b)


@pytest.mark.parametrize("change", ["entries", "files"])
def test_resumed_fit_stores_again_what_is_not_as_it_was(spark, no_broadcast, tmp_path, change):
    """Other entries of the same number, or copies cut short and sums deleted since: as if nothing had been kept."""
    import shutil

    _fit(spark, tmp_path / "run", 1)
    shutil.copytree(tmp_path / "run", tmp_path / "bare")
    seed = 2 if change == "entries" else 1
    if change == "files":
        for name in os.listdir(tmp_path / "run" / "entries"):
            parts = sorted(p for p in os.listdir(tmp_path / "run" / "entries" / name) if p.startswith("part-"))
            os.remove(tmp_path / "run" / "entries" / name / parts[0])
        shutil.rmtree(tmp_path / "run" / "sums")
    got = _fit(spark, tmp_path / "run", 2, resume=True, seed=seed)
    # The same factors, resumed by a session that broadcasts them: no stored copies and no sums.
    spark.conf.unset("spark.twinfold.maxBroadcastBytes")
    want = _fit(spark, tmp_path / "bare", 2, resume=True, seed=seed)
    _same(_rows(got.factor_table()), _rows(want.factor_table()))
