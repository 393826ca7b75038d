import numpy as np
import pytest

from test_fit import _model_factors
from twinfold.operators.factors import init_factor
from twinfold.plans.fit import fit
from twinfold.plans.layout import layout
from twinfold.spec import Coupling, FitConfig, Options, Stop, Tensor


def dense_sweep(tensors, F, groups, aligned, rank, common, lam, loss="ls"):
    """One sweep over any tensors from the algebra; ``tensors``: (indices, y) per tensor, ``F[(t, m)]`` updated in place."""
    means = {k: v.mean(axis=0) for k, v in F.items()}
    w = [1 / len(y) if loss == "wls" else 1.0 for _, y in tensors]

    def rows(t, m, cols):
        """Per entry: key, design over ``cols``, target without the other columns."""
        idx, y = tensors[t]
        full = np.ones((len(y), rank))
        for k in range(idx.shape[1]):
            if k != m:
                full *= F[(t, k)][idx[:, k]]
        rest = [c for c in range(rank) if c not in cols]
        return idx[:, m], full[:, cols], y - (full[:, rest] * F[(t, m)][idx[:, m]][:, rest]).sum(1)

    for t, (idx, _) in enumerate(tensors):
        for m in range(idx.shape[1]):
            group = next((g for g in groups if (t, m) in g), None)
            if group is None:
                others = [o for a in aligned if (t, m) in a for o in a if o != (t, m)]
                key, a, y = rows(t, m, list(range(rank)))
                new, n = F[(t, m)].copy(), len(F[(t, m)])
                pull = 1 / rank if loss == "wls" else 1.0
                for i in np.unique(key):
                    s = key == i
                    A, b = w[t] * a[s].T @ a[s] + lam * np.eye(rank), w[t] * a[s].T @ y[s]
                    for o in others:
                        A += pull * np.eye(rank) / n**2
                        b += pull * (means[o] - (means[(t, m)] - F[(t, m)][i] / n)) / n
                    new[i] = np.linalg.solve(A, b)
                F[(t, m)] = new
                continue
            if common and group[0] == (t, m):
                cols = list(range(common))
                eqs = {k: rows(*k, cols) for k in group}
                for i in range(len(F[(t, m)])):
                    seen = [k for k in group if (eqs[k][0] == i).any()]
                    if len(seen) > 1:
                        A, b = lam * np.eye(common), np.zeros(common)
                        for k in seen:
                            s = eqs[k][0] == i
                            A, b = A + w[k[0]] * eqs[k][1][s].T @ eqs[k][1][s], b + w[k[0]] * eqs[k][1][s].T @ eqs[k][2][s]
                        for k in seen:
                            F[k][i, :common] = np.linalg.solve(A, b)
            if common < rank:
                cols = list(range(common, rank))
                key, a, y = rows(t, m, cols)
                new = F[(t, m)].copy()
                for i in np.unique(key):
                    s = key == i
                    new[i, common:] = np.linalg.solve(w[t] * a[s].T @ a[s] + lam * np.eye(len(cols)), w[t] * a[s].T @ y[s])
                F[(t, m)] = new


def random_tensor(spark, seed, dims, n, absent=()):
    """Entries at random cells; ``absent``: (mode, index) pairs that occur nowhere."""
    rng = np.random.default_rng(seed)
    idx = np.stack([rng.integers(d, size=n) for d in dims], axis=1)
    for m, i in absent:
        idx = idx[idx[:, m] != i]
    y = rng.normal(size=len(idx)) + 1
    cols = [f"i{m} long" for m in range(len(dims))] + ["y double"]
    return Tensor(spark.createDataFrame([(*map(int, r), float(v)) for r, v in zip(idx, y)], ", ".join(cols)), dims), (idx, y)


CASES = {
    "chain, parts at 1, 0 and 2": ([(9, 7), (7, 5, 4), (3, 6, 7)], [(0, 1, 1, 0), (1, 0, 2, 2)], "ls", "sum", 2),
    "two domains": ([(9, 7), (7, 5), (9, 4)], [(0, 1, 1, 0), (0, 0, 2, 0)], "wls", "gram", 1),
    "all modes coupled": ([(6, 5), (5, 6)], [(0, 0, 1, 1), (0, 1, 1, 0)], "ls", "sum", 3),
}


@pytest.mark.parametrize("case", CASES)
def test_fit_matches_dense_model(spark, case):
    dims, pairs, loss, method, common = CASES[case]
    made = [random_tensor(spark, i, d, 60, [(m, 2) for t, m, _, _ in pairs if t == i][:1]) for i, d in enumerate(dims)]
    tensors, couplings = [m[0] for m in made], [Coupling(*p, i) for i, p in enumerate(pairs)]
    rank = 3
    cfg = FitConfig(rank=rank, common=common, options=Options(0.3, loss), stop=Stop(max_iter=2), init="lcg", method=method)
    model = fit(spark, tensors, couplings, cfg)
    F = {(t, m): np.stack([r.v for r in init_factor(spark, d, rank, "lcg", t, m).orderBy("idx").collect()])
         for t, ds in enumerate(dims) for m, d in enumerate(ds)}
    graph = layout(tensors, couplings)
    for _ in range(2):
        dense_sweep([m[1] for m in made], F, graph.groups, graph.aligned, rank, common, 0.3, loss)
    got = _model_factors_of(spark, model, 2)
    for k in F:
        np.testing.assert_allclose(got[k], F[k], rtol=1e-6, atol=1e-8)
    hist = {(i, term): v for i, _, term, v in model.history}
    sse = []
    for t, (idx, y) in enumerate(m[1] for m in made):
        e = y - np.prod([F[(t, k)][idx[:, k]] for k in range(idx.shape[1])], axis=0).sum(1)
        sse.append((e**2).sum() / (len(y) if loss == "wls" else 1))
        assert hist[(2, f"se_{t}")] == pytest.approx(sse[-1], rel=1e-7)
    gap = sum(((F[a].mean(0) - F[b].mean(0)) ** 2).sum() / (rank if loss == "wls" else 1) for a, b in graph.pairs(0))
    assert hist[(2, "mean")] == pytest.approx(gap, rel=1e-6, abs=1e-12)
    assert hist[(2, "total")] == pytest.approx(sum(sse) + gap, rel=1e-7)


def _model_factors_of(spark, model, it):
    model.paths = model.versions[it]
    return _model_factors(model)


def test_graph_of_the_coupling_map(spark):
    def tensor(*dims):
        return Tensor(spark.createDataFrame([], ", ".join([f"i{m} long" for m in range(len(dims))] + ["y double"])), dims)

    a, b, c = tensor(9, 7), tensor(7, 5, 4), tensor(3, 7)
    g = layout([a, b, c], [Coupling(2, 1, 0, 1), Coupling(1, 0, 0, 1)])
    assert g.groups == (((0, 1), (1, 0), (2, 1)),)
    assert g.aligned == (((0, 0), (1, 1), (2, 0)), ((1, 2),))
    assert g.pulled_by((1, 1)) == [(0, 0), (2, 0)] and g.pulled_by((1, 2)) == [] and g.group((0, 0)) is None
    for bad, pairs, why in (([a], [Coupling(0, 1, 0, 1)], "at least two"), ([a, b], [], "at least one"),
                            ([a, b], [Coupling(0, 1, 1, 1)], "same size"), ([a, b], [Coupling(0, 2, 1, 0)], "does not exist"),
                            ([a, c, c], [Coupling(0, 1, 1, 1)], "not coupled"),
                            ([tensor(7, 7), b], [Coupling(0, 0, 1, 0), Coupling(0, 1, 1, 0)], "two modes of one tensor")):
        with pytest.raises(ValueError, match=why):
            layout(bad, pairs)
