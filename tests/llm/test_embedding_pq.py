import numpy as np
import pytest

from twinfold.llm import embedding_pq, oracle


def brute(rows, threshold=0.98):
    """n_links and component_id by comparing all rows; also the smallest margin of a cosine from the threshold."""
    good = [i for i, (_, v, label) in enumerate(rows)
            if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))
    for key in {(rows[i][2], len(rows[i][1])) for i in good}:
        of = [i for i in good if (rows[i][2], len(rows[i][1])) == key]
        x = np.array([rows[i][1] for i in of], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            a, b = of[a], of[b]
            n[a], n[b] = n[a] + 1, n[b] + 1
            ra, rb = root[a], root[b]
            if ra != rb:
                root = [ra if r == rb else r for r in root]
    least = {}
    for (vec_id, _, _), r in zip(rows, root):
        if vec_id is not None:
            least[r] = min(least.get(r, vec_id), vec_id)
    return sorted(((vec_id, n[i], least.get(root[i]), vec_id == least.get(root[i])) for i, (vec_id, _, _) in enumerate(rows)), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    return sorted((tuple(r) for r in embedding_pq.near_duplicates(spark, df, **kw).collect()), key=repr)


def planted(seed, n, dim, labels=3):
    """Random vectors, with chains of near copies, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(n // 2, n):
        kind, j = rng.integers(4), rng.integers(n // 2)
        if kind == 0:
            x[i] = x[j]
        elif kind == 1:
            x[i] = x[j] * np.float32(rng.uniform(.1, 9))
        elif kind == 2:
            x[i] = x[j] + rng.normal(size=dim) * rng.uniform(0.02, 0.25)
    of = rng.integers(labels, size=n)
    of[n // 2:] = rng.integers(2, size=n - n // 2)
    return [(i, [float(v) for v in x[i]], int(of[i])) for i in rng.permutation(n).tolist()]


@pytest.mark.parametrize("seed,dim,rows_per_list,block", [(1, 64, 1024, 4096), (2, 64, 20, 30), (3, 5, 15, 4096), (4, 17, 10, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, dim, rows_per_list, block):
    monkeypatch.setattr(embedding_pq, "LIST_ROWS", rows_per_list)
    monkeypatch.setattr(embedding_pq, "BLOCK", block)
    rows = planted(seed, 500, dim)
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_pq, "LIST_ROWS", 25)
    monkeypatch.setattr(embedding_pq, "BLOCK", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    rows = [(i, [float(np.float32(v)) for v in base + rng.normal(size=32) * .12], 1) for i in range(200)]
    rows += [(1000 + i, [float(np.float32(v)) for v in base], 1) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_recall_in_high_dimension_with_many_lists():
    rng = np.random.default_rng(7)
    x = embedding_pq.unit(rng.normal(size=(4000, 64)))
    index = embedding_pq.Index(x[:2000], 128, 0.98)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = embedding_pq.unit(x + embedding_pq.unit(noise) * np.sqrt(1 / 0.9801 ** 2 - 1))
    assert (x * y).sum(1).min() > 0.98
    home_x, visits_x = index.place(x)
    home_y, visits_y = index.place(y)
    met = (home_x == home_y) | visits_x[np.arange(len(x)), home_y] | visits_y[np.arange(len(x)), home_x]
    assert met.mean() >= 0.999
    # Table look-ups never rule a partner out.
    for h in range(4):
        at = np.flatnonzero(home_y == h)
        codes, error = index.encode(y[at], h)
        d = index.distances(x[at], h, codes)
        assert (np.diag(d) <= index.radius + error + embedding_pq.SLACK).all()


def test_unusable_vectors_odd_ids_and_columns(spark):
    v, w = [1.0, 0.0, 2.0], [1.0, 0.01, 2.0]
    rows = [(1, v, 1), (2, w, 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [float("nan"), 0.0, 2.0], 1),
            (8, [float("inf"), 0.0, 1.0], 1), (9, v, None), (10, v, 2), (11, [-1.0, 0.0, -2.0], 1), (12, [1.0, 0.0, 2.0, 0.0], 1),
            (13, [1e-38, 0.0, 2e-38], 1), (14, [1e38, 0.0, 2e38], 1)]
    assert run(spark, rows) == brute(rows)
    odd = [(None, v, 1), (7, w, 1), (7, v, 1), (3, v, 1), (None, [0.0], 1), (None, v, 5)]
    got = run(spark, odd)
    assert got == sorted([(None, 3, 3, False), (7, 3, 3, False), (7, 3, 3, False), (3, 3, 3, True), (None, 0, None, True), (None, 0, None, True)], key=repr)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, v, 1, 5, 6), (2, v, 1, 5, 6)], "vec_id long, embedding array<double>, label int, rep long, n_links long")
    assert sorted(tuple(r) for r in embedding_pq.near_duplicates(spark, df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_table_and_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted(tuple(r) for r in embedding_pq.near_duplicates(spark, df).collect())
    assert got == sorted(con.execute(oracle.OP12).fetchall())
