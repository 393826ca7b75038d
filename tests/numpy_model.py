"""Dense NumPy model of the coupled ALS sweep, written from the algebra.

Used as the oracle for the iterative parts (M4-M8) that SQL cannot express.
Factors are dicts ``(t, m) -> ndarray[dim, rank]``; tensors are
``(indices ndarray[n, N], y ndarray[n])``.
"""

import numpy as np


def predict(idx, factors_t):
    prod = np.ones((idx.shape[0], factors_t[0].shape[1]))
    for m, f in enumerate(factors_t):
        prod *= f[idx[:, m]]
    return prod.sum(axis=1)


def _solve(A, b, lam):
    return np.linalg.solve(A + lam * np.eye(A.shape[0]), b)


def _design(idx, fac, mode, cols):
    a = np.ones((idx.shape[0], len(cols)))
    for k, f in enumerate(fac):
        if k != mode:
            a *= f[idx[:, k]][:, cols]
    return a


def _resid(idx, y, fac, cols):
    prod = np.ones((idx.shape[0], len(cols)))
    for k, f in enumerate(fac):
        prod *= f[idx[:, k]][:, cols]
    return y - prod.sum(axis=1)


def sweep(tensors, F, cm, rank, common, lam, loss="ls"):
    """One sweep; ``F[(t, m)]`` updated in place; coupled mode ``cm`` in both tensors."""
    n_modes = tensors[0][0].shape[1]
    counts = [len(y) for _, y in tensors]
    means = {k: v.mean(axis=0) for k, v in F.items()}
    w = [1.0 / c if loss == "wls" else 1.0 for c in counts]
    for t in range(2):
        idx, y = tensors[t]
        for m in range(n_modes):
            fac = [F[(t, k)] for k in range(n_modes)]
            if m == cm:
                if common > 0 and t == 0:
                    cols = list(range(common))
                    rest = list(range(common, rank))
                    eqs = []
                    for tt in (0, 1):
                        ii, yy = tensors[tt]
                        ff = [F[(tt, k)] for k in range(n_modes)]
                        a = _design(ii, ff, m, cols)
                        r = _resid(ii, yy, ff, rest)
                        eqs.append((ii[:, m], a, r, w[tt]))
                    keys = set(eqs[0][0]) & set(eqs[1][0])
                    for key in keys:
                        A = np.zeros((common, common)); b = np.zeros(common)
                        for kk, a, r, ww in eqs:
                            s = kk == key
                            A += ww * a[s].T @ a[s]; b += ww * a[s].T @ r[s]
                        x = _solve(A, b, lam)
                        F[(0, m)][key, :common] = x
                        F[(1, m)][key, :common] = x
                    fac = [F[(t, k)] for k in range(n_modes)]
                if common < rank:
                    cols = list(range(common, rank))
                    a = _design(idx, fac, m, cols)
                    r = _resid(idx, y, fac, list(range(common)))
                    new = F[(t, m)].copy()
                    for key in np.unique(idx[:, m]):
                        s = idx[:, m] == key
                        x = _solve(w[t] * a[s].T @ a[s], w[t] * a[s].T @ r[s], lam)
                        new[key, common:] = x
                    F[(t, m)] = new
            else:
                other = 1 - t
                a = _design(idx, fac, m, list(range(rank)))
                L = F[(t, m)].shape[0]
                w2 = 1.0 / rank if loss == "wls" else 1.0
                new = F[(t, m)].copy()
                for key in np.unique(idx[:, m]):
                    s = idx[:, m] == key
                    A = w[t] * a[s].T @ a[s] + w2 * np.eye(rank) / L**2
                    z = means[(other, m)] - (means[(t, m)] - F[(t, m)][key] / L)
                    b = w[t] * a[s].T @ y[s] + w2 * z / L
                    new[key] = _solve(A, b, lam)
                F[(t, m)] = new
    return F


def total_loss(tensors, F, cm, rank, loss="ls"):
    n_modes = tensors[0][0].shape[1]
    out = []
    for t, (idx, y) in enumerate(tensors):
        sse = float(((y - predict(idx, [F[(t, k)] for k in range(n_modes)])) ** 2).sum())
        out.append(sse / len(y) if loss == "wls" else sse)
    m = [k for k in range(n_modes) if k != cm][0]
    ml = float(((F[(0, m)].mean(0) - F[(1, m)].mean(0)) ** 2).sum())
    if loss == "wls":
        ml /= rank
    return out, ml
