"""Batched ridge solve (A5): ``(ata + lam I) x = atb`` for every key.

Spark has no built-in small dense solver, so this is the one place the fit
drops to Python: an Arrow-batched pandas UDF that receives thousands of keys'
equations as columns and solves them together with NumPy's stacked
``cholesky`` / ``solve``. Keys without entries have null equations and come
back as NaN, which the caller replaces by their rows. Equations of a key with
entries must be finite: NaN or infinity anywhere fails, naming the keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import cell_names, rhs_names


class NotPositiveDefinite(ValueError):
    pass


class NotFinite(ValueError):
    pass


def solve_equations(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Solutions of stacked positive definite systems; fails naming the first keys whose system is not finite or not
    positive definite."""
    if len(a) == 0:
        return np.zeros((0, b.shape[1]))
    finite = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    if not finite.all():
        raise NotFinite(f"normal equations are not finite for keys {np.asarray(keys)[~finite][:10].tolist()}")
    try:
        chol = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        bad = [i for i in range(len(a)) if np.linalg.eigvalsh(a[i]).min() <= 0]
        raise NotPositiveDefinite(f"normal equations are not positive definite for keys {np.asarray(keys)[bad][:10].tolist()}"
                                  " (lam = 0 with too few entries?)") from None
    # Two stacked triangular solves through the Cholesky factor L L^T.
    z = np.linalg.solve(chol, b[..., None])
    return np.linalg.solve(np.swapaxes(chol, 1, 2), z)[..., 0]


def solve_batch(ne: pd.DataFrame, k: int, lam: float) -> np.ndarray:
    """Solve every row of a batch that is ``due``; returns an ``(n, k)`` array (NaN elsewhere)."""
    n = len(ne)
    a = np.zeros((n, k, k))
    b = np.empty((n, k))
    for p, q, name in cell_names(k):
        col = ne[name].to_numpy(dtype="float64", na_value=np.nan)
        a[:, p, q] = col
        a[:, q, p] = col
    for p, name in enumerate(rhs_names(k)):
        b[:, p] = ne[name].to_numpy(dtype="float64", na_value=np.nan)
    diag = np.arange(k)
    a[:, diag, diag] += lam
    due = ne["due"].to_numpy(dtype=bool)
    x = np.full((n, k), np.nan)
    x[due] = solve_equations(a[due], b[due], ne["key"].to_numpy()[due])
    return x


def solve_column(k: int, lam: float, key: str = "key", due: str = "n > 0") -> Column:
    """A struct column ``x_0..x_{k-1}`` holding the solution of each row for which ``due`` (SQL) holds."""
    names = [n for _, _, n in cell_names(k)] + rhs_names(k)
    schema = T.StructType([T.StructField(f"x_{p}", T.DoubleType()) for p in range(k)])
    lam_f = float(lam)

    @F.pandas_udf(schema)
    def _solve(ne: pd.DataFrame) -> pd.DataFrame:
        x = solve_batch(ne, k, lam_f)
        return pd.DataFrame({f"x_{p}": x[:, p] for p in range(k)})

    pairs = [f"'key', {key}", f"'due', coalesce({due}, false)"] + [f"'{n}', {n}" for n in names]
    return _solve(F.expr(f"named_struct({', '.join(pairs)})"))


def ridge_solve(ne: DataFrame, k: int, lam: float, key: str = "key") -> DataFrame:
    """``key, x array<double>`` for every row of a normal-equation table.

    A key is solved if its count ``n`` is above 0 or, in a table without counts, if it has equations.
    """
    s = solve_column(k, lam, key, "n > 0" if "n" in ne.columns else "ata_0_0 IS NOT NULL")
    return ne.select(F.col(key), s.alias("_x")).select(
        F.col(key), F.array(*[F.col("_x")[f"x_{p}"] for p in range(k)]).alias("x"))
