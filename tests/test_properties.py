"""Property tests (hypothesis) for the pure batch kernels."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from twinfold.operators.gram import _gram_rows, _starts, running_sums
from twinfold.operators.solve import solve_batch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200), st.lists(st.integers(1, 40), min_size=1, max_size=10))
def test_running_sums_are_complete_and_lossless(keys, cuts):
    keys = np.array(sorted(keys))
    batches, i = [], 0
    for c in cuts * 200:
        batches.append((keys[i:i + c], keys[i:i + c, None] + 1.0))
        i += c
    out = list(running_sums(iter(batches)))
    got = [int(k) for ks, _ in out for k in ks]
    assert got == sorted(set(keys.tolist()))
    total = {k: (k + 1.0) * int((keys == k).sum()) for k in got}
    assert {int(k): v[0] for ks, vs in out for k, v in zip(ks, vs)} == total


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(0, 2**31 - 1))
def test_gram_rows_equal_dense_sums(k, keys, seed):
    keys = np.array(sorted(keys))
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(len(keys), k))
    t = rng.normal(size=len(keys))
    starts = _starts(keys)
    g = _gram_rows(a, t, starts, k)
    iu = np.triu_indices(k)
    for r, key in enumerate(keys[starts]):
        s = keys == key
        dense = a[s].T @ a[s]
        np.testing.assert_allclose(g[r, : len(iu[0])], dense[iu], atol=1e-9)
        np.testing.assert_allclose(g[r, len(iu[0]):-1], a[s].T @ t[s], atol=1e-9)
        np.testing.assert_allclose(g[r, -1], t[s] @ t[s], atol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 7), st.integers(1, 20), st.floats(0.01, 5.0), st.integers(0, 2**31 - 1))
def test_solve_batch_is_the_ridge_solution(k, n, lam, seed):
    rng = np.random.default_rng(seed)
    rows, mats = [], []
    for i in range(n):
        a = rng.normal(size=(rng.integers(0, 12), k))
        m, b = a.T @ a, rng.normal(size=k)
        row = {"key": i, "due": True}
        for p in range(k):
            for q in range(p, k):
                row[f"ata_{p}_{q}"] = m[p, q]
            row[f"atb_{p}"] = b[p]
        rows.append(row)
        mats.append((m, b))
    x = solve_batch(pd.DataFrame(rows), k, lam)
    for i, (m, b) in enumerate(mats):
        np.testing.assert_allclose((m + lam * np.eye(k)) @ x[i], b, atol=1e-7 * (1 + np.abs(b).max()))
