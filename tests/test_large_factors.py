"""Factors above the broadcast bound: what is read and moved to meet them."""

import pytest

from test_plans import _above, _plan
from twinfold.operators import factors as fo
from twinfold.operators import normal, update
from twinfold.operators.factors import init_factor
from twinfold.spec import Options, Tensor


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.twinfold.maxBroadcastBytes", "0")
    yield
    spark.conf.unset("spark.twinfold.maxBroadcastBytes")


def _tensor(spark, copies=1):
    """40 x 30 entries, a third of them on index 7 of mode 1; each ``copies`` times."""
    e = spark.range(600 * copies).selectExpr("id % 40 AS i0", "CASE WHEN id % 3 = 0 THEN 7L ELSE (id * 7) % 30 END AS i1",
                                             "CAST(id % 11 AS DOUBLE) AS y")
    return Tensor(e, (40, 30), "t")


def _factors(spark, rank):
    return {m: init_factor(spark, d, rank, "lcg", 0, m) for m, d in enumerate((40, 30))}


def _rows(df):
    return {r.idx: list(r.v) for r in df.collect()}


def _jobs_of(spark, group, build):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = build()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_entries_are_built_once_to_meet_a_large_factor(spark, no_broadcast):
    """No job while the update is planned, and one scan of the entries in its plan."""
    t, f = _tensor(spark), _factors(spark, 3)
    for i, build in enumerate((lambda: update.update_uncoupled(spark, t, f, 0, 3, Options(0.1), 0),
                               lambda: update.update_specific(spark, t, f, 1, 3, 2, Options(0.1), 0))):
        df, jobs = _jobs_of(spark, f"planned-{i}", build)
        assert jobs == 0
        plan = _plan(df)
        assert "SortMergeJoin" in plan and plan.count("Range (0, 600") == 1


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("method", ["sum", "gram"])
def test_hot_indices_give_the_rows_of_the_broadcast_join(spark, adaptive, method):
    t, f = _tensor(spark, 3), _factors(spark, 3)

    def both():
        return (_rows(update.update_uncoupled(spark, t, f, 0, 3, Options(0.1), 0, method=method)),
                _rows(update.update_specific(spark, t, f, 1, 3, 1, Options(0.1), 0, method=method)))

    want = both()
    spark.conf.set("spark.twinfold.maxBroadcastBytes", "0")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = both()
    finally:
        spark.conf.unset("spark.twinfold.maxBroadcastBytes")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for a, b in zip(want, got):
        assert a.keys() == b.keys()
        for k in a:
            assert b[k] == pytest.approx(a[k], rel=1e-9, abs=1e-12)


def test_entries_by_part_do_not_move_to_meet_the_parts(spark, sf, no_broadcast):
    """X1 and X2 come dealt by part: no exchange of entries between their cells and the join with the parts' factor."""
    from twinfold.plans.catalog import lcg_factors, x1, x2

    for i, t in enumerate((x1(spark, sf), x2(spark, sf))):
        j = fo.join_factors(spark, t.entries, lcg_factors(spark, t, i, 2), t.dims, [1], 2)
        lines = _plan(j).split("\n")
        joins = [n for n, line in enumerate(lines) if "SortMergeJoin" in line and "LeftOuter" in line]
        assert len(joins) == 1
        cells = next(n for n, line in enumerate(lines) if "HashAggregate" in line)
        assert not [line for line in lines[joins[0]:cells] if "Exchange" in line]


@pytest.mark.parametrize("query", ["update_common_gram", "update_shared_pieces", "update_specific_all", "normal_merge"])
def test_entries_move_once_to_meet_a_large_factor_of_the_other_mode(spark, sf, no_broadcast, query):
    """An update of parts: no exchange of entries between their cells and the join with the factor of mode 0."""
    from twinfold.plans.catalog import QUERIES

    lines = _plan(QUERIES[query](spark, sf)).split("\n")
    joins = [n for n, line in enumerate(lines) if "SortMergeJoin [i0#" in line and "LeftOuter" in line]
    assert len(joins) == (1 if query == "update_specific_all" else 2)
    for join in joins:
        cells = next(n for n, line in enumerate(lines) if n > join and "HashAggregate" in line)
        assert not [line for line in lines[join:cells] if "Exchange" in line]


def test_entries_lie_by_the_factor_they_meet_first(spark, sf):
    """The cells are the same wherever they lie; by part unless the factor of mode 0 is too large to broadcast."""
    from twinfold.plans.catalog import of_parts, x1, x2

    for small in (True, False):
        spark.conf.set("spark.twinfold.maxBroadcastBytes", str(10**9 if small else 0))
        try:
            tensors = of_parts(spark, sf, 3)
        finally:
            spark.conf.unset("spark.twinfold.maxBroadcastBytes")
        for t, same in zip(tensors, (x1(spark, sf), x2(spark, sf))):
            assert ("REPARTITION_BY_COL" in _plan(t.entries)) and f"hashpartitioning({'i1' if small else 'i0'}#" in _plan(t.entries)
            assert sorted(map(tuple, t.entries.collect())) == sorted(map(tuple, same.entries.collect()))
            assert t.dims == same.dims


def test_binned_heavy_indices_are_the_counted_ones(spark):
    t = _tensor(spark, 5)
    for mode in range(2):
        for rows in (1, 20, 100, 10**6):
            want, got = ({(r.idx, r.salts) for r in fo.heavy_indices(t.entries, mode, rows, bins).collect()} for bins in (None, 16))
            assert got == want


def test_fit_keeps_one_copy_per_bucketing(spark, no_broadcast):
    """Modes that ask for the same buckets share a table; entries in buckets of the mode itself do not move to be summed."""
    from pyspark import StorageLevel

    from twinfold.plans.fit import _layout
    from twinfold.session import run_dir
    from twinfold.spec import FitConfig

    spark.conf.set("spark.twinfold.maxBroadcastBytes", "2000")
    cfg, held, tables = FitConfig(rank=2, common=1, split=3), [], []
    e = spark.range(900).selectExpr("id % 5 AS i0", "id % 180 AS i1", "CAST(id % 11 AS DOUBLE) AS y")
    t = Tensor(e, (5, 180), "t")
    n, _, copies, hot = _layout(spark, t, cfg, StorageLevel.MEMORY_AND_DISK, held, run_dir(spark, "layout"), tables)
    try:
        assert n == 900 and len(tables) == 1
        assert all(c.entries.count() == 900 for c in copies)
        f = {m: init_factor(spark, d, 2, "lcg", 0, m) for m, d in enumerate(t.dims)}
        obs = normal.observations(spark, copies[1], f, 1, [1], 2, heavy=hot)
        chains = list(_above(_plan(obs), "Bucketed: true"))
        assert chains and not [line for chain in chains for line in chain if "Exchange" in line]
        want = normal.observations(spark, t, f, 1, [1], 2, with_own=True, heavy=hot)
        assert sorted(map(tuple, obs.collect())) == sorted(map(tuple, want.collect()))
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE {name}")
        for df in held:
            df.unpersist()


def test_a_small_split_is_no_bound_on_shuffles(spark, tmp_path):
    """The job raises the shuffle partitions to its split, never below the session's."""
    from twinfold.plans import job

    for i in range(2):
        rows = [f"{a}\t{b}\t{1 + (a * b + i) % 5}" for a in range(6) for b in range(5)]
        (tmp_path / f"x{i}").mkdir()
        (tmp_path / f"x{i}" / "part").write_text("\n".join(rows) + "\n")
    (tmp_path / "map").write_text("0_1\t1_1\n")
    args = [a for i in range(2) for a in ("--tensor", f"{tmp_path}/x{i}:6_5")]
    args += ["--coupling", f"{tmp_path}/map", "--rank", "2", "--common", "1", "--stop", "1_1", "--init", "lcg", "--split", "3"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        job.run(spark, job.parse_args([*args, "--output", f"{tmp_path}/out"]))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == max(3, int(old))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
