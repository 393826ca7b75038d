"""Plan checks: the physical plans the fit relies on at scale."""

import pytest

from pyspark import StorageLevel

from twinfold.operators import update
from twinfold.operators.factors import init_factor
from twinfold.operators.tensor import cluster_by_mode
from twinfold.plans.catalog import lcg_factors, x1, x2
from twinfold.plans.fit import FactorStore
from twinfold.session import MAX_BROADCAST_BYTES, fits_broadcast, run_dir
from twinfold.spec import Options


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _factors(spark, t, ti, rank):
    store = FactorStore(spark, run_dir(spark, "plantest"))
    store.put_many({(ti, m): init_factor(spark, d, rank, "lcg", ti, m) for m, d in enumerate(t.dims)}, "i")
    return {m: store.frames[(ti, m)] for m in range(t.n_modes)}


def test_update_is_one_shuffle_with_broadcast_factor(spark, sf):
    a = x1(spark, sf)
    a = a.with_entries(cluster_by_mode(a.entries, 0, 2, 4).persist(StorageLevel.MEMORY_AND_DISK))
    f = _factors(spark, a, 0, 5)
    df = update.update_uncoupled(spark, a, f, 0, 5, Options(0.1), 0, [0.5] * 5, [0.5] * 5, method="sum")
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan
    assert "InMemoryTableScan" in plan
    assert "partial_sum" in plan
    # one hash exchange on the key after the partial aggregate; no sort-merge join, no sort aggregate
    update_part = plan.split("InMemoryRelation")[0]
    assert update_part.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in update_part and "SortAggregate" not in update_part
    assert "ObjectHashAggregate" not in update_part
    a.entries.unpersist()


def test_broadcast_only_below_bound(spark):
    assert fits_broadcast(spark, 10, 5)
    assert not fits_broadcast(spark, 10**9, 50)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100g")
    try:
        assert not fits_broadcast(spark, MAX_BROADCAST_BYTES // 8, 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_gram_path_has_no_entry_lists(spark, sf):
    a, b = x1(spark, sf), x2(spark, sf)
    fa, fb = lcg_factors(spark, a, 0, 4), lcg_factors(spark, b, 1, 4)
    df = update.update_common(spark, a, fa, 1, 0, b, fb, 1, 0, 4, 2, Options(0.1), method="gram")
    plan = _plan(df)
    assert "collect_list" not in plan and "MapInPandas" in plan and "MapInArrow" in plan


@pytest.mark.parametrize("method", ["sum", "gram"])
@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_update_plans_hold_no_lists_or_cross_joins(spark, sf, method, threshold):
    a, b = x1(spark, sf), x2(spark, sf)
    fa, fb = lcg_factors(spark, a, 0, 4), lcg_factors(spark, b, 1, 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plans = [_plan(df) for df in (
            update.update_uncoupled(spark, a, fa, 0, 4, Options(0.1), 0, method=method),
            update.update_specific(spark, a, fa, 1, 4, 2, Options(0.1), 0, method=method),
            update.update_common(spark, a, fa, 1, 0, b, fb, 1, 0, 4, 2, Options(0.1), method=method))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for plan in plans:
        for node in ("collect_list", "collect_set", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert node not in plan


def test_factor_plans_do_not_grow_with_iterations(spark, sf):
    """Each factor version is read back from parquet: its plan is a bare scan."""
    a = x1(spark, sf)
    f = _factors(spark, a, 0, 3)
    store = FactorStore(spark, run_dir(spark, "grow"))
    store.put_many({(0, m): f[m] for m in range(2)}, "i")
    sizes = []
    for i in range(3):
        fac = {m: store.frames[(0, m)] for m in range(2)}
        store.put((0, 0), update.update_uncoupled(spark, a, fac, 0, 3, Options(0.1), 0), f"it{i}")
        sizes.append(len(store.frames[(0, 0)]._jdf.queryExecution().analyzed().toString()))
    assert len(set(sizes)) == 1


def test_shuffle_join_path_when_factor_exceeds_bound(spark, sf):
    """With broadcast disabled the update plans a shuffle join and gives the same rows."""
    a = x1(spark, sf)
    f = lcg_factors(spark, a, 0, 3)
    want = {r.idx: list(r.v) for r in update.update_uncoupled(spark, a, f, 0, 3, Options(0.1), 0).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = update.update_uncoupled(spark, a, f, 0, 3, Options(0.1), 0)
        plan = _plan(df)
        assert "SortMergeJoin" in plan
        got = {r.idx: list(r.v) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)


def _above(plan, leaf):
    """Node lines between a leaf that contains ``leaf`` and the root, nearest first, for every such leaf."""
    lines = [line for line in plan.split("\n") if line.strip()]
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if leaf in line:
            chain, d = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < d:
                    chain.append(lines[j])
                    d = depth[j]
            yield chain


@pytest.mark.parametrize("update_of", ["uncoupled", "specific"])
def test_stored_entries_do_not_move_to_meet_a_large_factor(spark, sf, update_of):
    from twinfold.operators.factors import heavy_indices, store_entries

    a = x1(spark, sf)
    f = _factors(spark, a, 0, 4)
    mode = 0 if update_of == "uncoupled" else 1

    def updated(t, heavy=None):
        if update_of == "uncoupled":
            return update.update_uncoupled(spark, t, f, mode, 4, Options(0.1), 0, heavy=heavy)
        return update.update_specific(spark, t, f, mode, 4, 1, Options(0.1), 0, heavy=heavy)

    want = {r.idx: list(r.v) for r in updated(a).collect()}
    spark.conf.set("spark.twinfold.maxBroadcastBytes", "0")
    try:
        hot = {m: heavy_indices(a.entries, m, rows=5).persist() for m in range(2)}
        name = f"stored_{update_of}"
        stored = a.with_entries(store_entries(spark, a.entries, 1 - mode, 2, hot[1 - mode], 8, name, f"{run_dir(spark, 'st')}/{name}"))
        df = updated(stored, hot)
    finally:
        spark.conf.unset("spark.twinfold.maxBroadcastBytes")
    chains = list(_above(_plan(df), "Bucketed: true"))
    assert chains
    for chain in chains:
        joined = next(i for i, line in enumerate(chain) if "SortMergeJoin" in line)
        assert not [line for line in chain[:joined] if "Exchange" in line]
        # Then the entries move once, to their keys, before the partial aggregate; its sums move once more.
        assert len([line for line in chain if "Exchange" in line]) == 2
    got = {r.idx: list(r.v) for r in df.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)
    spark.sql(f"DROP TABLE {name}")


def test_shuffle_queries_join_by_sort_merge(spark, sf):
    from twinfold.plans.catalog import QUERIES

    for name in ("update_uncoupled_shuffle", "update_specific_shuffle", "update_common_shuffle", "update_stored"):
        df = QUERIES[name](spark, sf)
        df.collect()
        final = _plan(df).split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in final, name


def test_heavy_list_is_bounded_by_the_shuffle_partitions(spark, sf):
    from twinfold.operators.factors import heavy_indices

    a = x1(spark, sf)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert heavy_indices(a.entries, 0).count() <= parts
    one = spark.range(1000).selectExpr("0L AS i0", "id AS i1", "1D AS y")
    assert [(r.idx, r.salts) for r in heavy_indices(one, 0).collect()] == [(0, parts)]


def test_fit_with_large_factors_equals_broadcast_fit(spark, sf):
    from twinfold.plans.fit import fit
    from twinfold.sources import tpch
    from twinfold.spec import FitConfig, Stop

    tensors, valid, coup = tpch.coupled_pair(spark, sf)
    cfg = FitConfig(rank=3, common=1, stop=Stop(max_iter=1), init="lcg")
    want = fit(spark, tensors, coup, cfg, validation=valid)
    tables = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.twinfold.maxBroadcastBytes", "0")
    try:
        got = fit(spark, tensors, coup, cfg, validation=valid)
    finally:
        spark.conf.unset("spark.twinfold.maxBroadcastBytes")
    assert {t.name for t in spark.catalog.listTables()} == tables
    a, b = ({(r.tensor, r.mode, r.idx): list(r.v) for r in m.factor_table(m.versions[1]).collect()} for m in (want, got))
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=1e-8, abs=1e-11)
    for (i, _, term, v), (_, _, _, w) in zip(want.history, got.history):
        assert w == pytest.approx(v, rel=1e-8, abs=1e-10), (i, term)
