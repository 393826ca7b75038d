import __spark_entry__ as ent


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"i0", "i1", "y", "yhat", "tensor"} <= set(df.columns)


def test_registry_consistent():
    q, s = ent.queries(), ent.oracle_sql()
    assert set(s) <= set(q)
    llm, pipeline = ent._training_text()
    assert (llm is None) == (not any(n.startswith("op") for n in q))
    assert (pipeline is None) == ("pipeline" not in q)
