"""Naming conventions and element-wise expressions over factor rows.

Factor rows are ``array<double>`` columns. Products and sums over them are
written with ``v[r]`` element access rather than higher-order functions
(``zip_with``/``aggregate`` fall back to interpreted evaluation), so every
expression here stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_columns(n_modes: int) -> list[str]:
    """Index column names of an ``n_modes`` tensor: ``i0 .. i{n-1}``."""
    return [f"i{m}" for m in range(n_modes)]


def entry_columns(n_modes: int) -> list[str]:
    return index_columns(n_modes) + ["y"]


def vector_columns(n_modes: int) -> list[str]:
    """Name of the joined factor row for each mode: ``f0 .. f{n-1}``."""
    return [f"f{m}" for m in range(n_modes)]


def cell_names(k: int) -> list[tuple[int, int, str]]:
    """Upper-triangle cells of a k x k normal matrix, row-major: (p, q, name)."""
    return [(p, q, f"ata_{p}_{q}") for p in range(k) for q in range(p, k)]


def rhs_names(k: int) -> list[str]:
    return [f"atb_{p}" for p in range(k)]


def row_product(vectors: Sequence[str], r: int) -> Column:
    """``prod_k vectors[k][r]`` - one column of a Khatri-Rao row."""
    if not vectors:
        return F.lit(1.0)
    return reduce(lambda acc, c: acc * c, [F.col(v)[r] for v in vectors])


def cp_sum(vectors: Sequence[str], columns: Iterable[int]) -> Column:
    """``sum_{r in columns} prod_k vectors[k][r]`` - a CP reconstruction."""
    terms = [row_product(vectors, r) for r in columns]
    if not terms:
        return F.lit(0.0)
    return reduce(lambda acc, c: acc + c, terms)
