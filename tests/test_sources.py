import pytest
from pyspark.sql import functions as F

from twinfold.sources import tables, text, tpch
from twinfold.spec import Coupling


def _write(path, lines):
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_read_tensor_typed(spark, scratch):
    p = f"{scratch}/t.txt"
    _write(p, ["0\t1\t2.5", "3\t0\t0", "1\t1\t-1e-3"])
    t = text.read_tensor(spark, p, (4, 2))
    assert t.entries.dtypes == [("i0", "bigint"), ("i1", "bigint"), ("y", "double")]
    rows = sorted(tuple(r) for r in t.entries.collect())
    assert rows == [(0, 1, 2.5), (1, 1, -0.001), (3, 0, 0.0)]


def test_read_three_mode(spark, scratch):
    p = f"{scratch}/t3.txt"
    _write(p, ["0\t1\t2\t1.0", "1\t0\t0\t2.0"])
    t = text.read_tensor(spark, p, (2, 2, 3))
    assert t.entries.count() == 2 and t.n_modes == 3


def test_malformed_number_fails(spark, scratch):
    p = f"{scratch}/bad.txt"
    _write(p, ["0\t1\t2.5", "x\t0\t1.0"])
    with pytest.raises(Exception):
        text.read_entries(spark, p, 2).collect()


def test_round_trip(spark, sf, scratch):
    e = tpch.x2_entries(spark, sf)
    text.write_entries(e, f"{scratch}/x2", 2)
    back = text.read_entries(spark, f"{scratch}/x2", 2)
    assert back.exceptAll(e).count() == 0 and e.exceptAll(back).count() == 0


def test_coupling_map(spark, scratch):
    p = f"{scratch}/map.txt"
    _write(p, ["0_1\t1_1", "1_0\t2_0"])
    df = text.read_coupling(spark, p)
    pairs = text.collect_couplings(df)
    assert pairs == [Coupling(0, 1, 1, 1, 0), Coupling(1, 0, 2, 0, 1)]
    look = {(r.t, r.m): (r.partner_t, r.partner_m, r.pair) for r in text.coupling_lookup(df).collect()}
    assert look[(1, 1)] == (0, 1, 0) and look[(2, 0)] == (1, 0, 1)
    assert pairs[0].partner(1, 1) == (0, 1) and pairs[0].partner(0, 0) is None


def test_index_mode_dense_and_sorted(spark):
    df = spark.createDataFrame([(v,) for v in [50, 7, 7, 1000, -3, 50, 12]], "k long").repartition(3)
    ids = {r.value: r.idx for r in tables.index_mode(df, "k").collect()}
    assert ids == {-3: 0, 7: 1, 12: 2, 50: 3, 1000: 4}


def test_tensor_from_and_apply_index(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 20, 2.0), ("a", 20, 3.0)], "u string, it long, y double")
    ids = tables.index_mode(df, "u")
    e = tables.apply_index(df, "u", ids, "u_idx")
    t = tables.tensor_from(e, ["u_idx", "it"], "y", dims=(2, 21))
    got = sorted(tuple(r) for r in t.entries.collect())
    assert got == [(0, 10, 1.0), (0, 20, 3.0), (1, 20, 2.0)]


def test_split_is_a_partition(spark, sf):
    e = tpch.x1_entries(spark, sf)
    tr, va = tpch.split(e)
    assert tr.count() + va.count() == e.count()
    assert tr.join(va, ["i0", "i1"]).count() == 0


def test_index_mode_is_dense_and_sorted_whatever_is_reused(spark):
    """Ids of a column with many values: 0 .. n-1 in sorted order, with and without exchange reuse."""
    from pyspark.sql import functions as F

    from twinfold.sources import tables, tpch

    li = tpch.table(spark, "/root/testdata/sf0.01", "lineitem")
    n = li.select("l_extendedprice").distinct().count()
    old = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            ids = tables.index_mode(li, "l_extendedprice")
            row = ids.agg(F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
            assert tuple(row) == (n, n, 0, n - 1)
            values = [r.value for r in ids.orderBy("idx").collect()]
            assert values == sorted(values)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_long_coupling_maps_are_read_whole(spark, tmp_path):
    from twinfold.sources import text

    (tmp_path / "map.txt").write_text("".join(f"0_{i}\t1_{i}\n" for i in range(1500)))
    got = text.collect_couplings(text.read_coupling(spark, str(tmp_path / "map.txt")))
    assert [(c.m1, c.m2, c.pair) for c in got] == [(i, i, i) for i in range(1500)]
