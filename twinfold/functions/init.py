"""Deterministic factor initial values.

The reference draws ``Random.nextDouble`` on the driver. Here each cell is a
pure function of (seed, tensor, mode, index, column), so the value does not
depend on partitioning or on which executor computes it, and a recomputed
partition after an executor loss yields the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the ``lcg`` initialiser (chosen so SQL engines can repeat it
# with 64-bit integer arithmetic): multipliers per index, column, tensor, mode;
# additive offset; modulus.
LCG_IDX = 7919
LCG_COL = 104729
LCG_TENSOR = 15485863
LCG_MODE = 32452843
LCG_OFFSET = 17
LCG_MOD = 1000003

# ``random``: so many leading hex digits of the MD5 make a value (52 bits, exact in a double).
RANDOM_DIGITS = 13


def lcg_uniform(idx: Column, c: int, tensor: int, mode: int) -> Column:
    """Value in [0, 1): ``((idx*7919 + c*104729 + t*15485863 + m*32452843 + 17) % 1000003) / 1000003``."""
    base = c * LCG_COL + tensor * LCG_TENSOR + mode * LCG_MODE + LCG_OFFSET
    num = F.pmod(idx.cast("long") * F.lit(LCG_IDX) + F.lit(base), F.lit(LCG_MOD))
    return num.cast("double") / F.lit(float(LCG_MOD))


def hash_uniform(idx: Column, c: int, tensor: int, mode: int, seed: int) -> Column:
    """Value in [0, 1) from the first 13 hex digits of ``md5("seed:tensor:mode:idx:column")``."""
    text = F.concat_ws(":", F.lit(f"{seed}:{tensor}:{mode}"), idx.cast("long").cast("string"), F.lit(str(c)))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, RANDOM_DIGITS), 16, 10)
    return digits.cast("double") / F.lit(float(16**RANDOM_DIGITS))


def init_value(method: str, idx: Column, c: int, tensor: int, mode: int,
               seed: int = 0, value: float = 1.0, diag_rows: int | None = None) -> Column:
    """Initial value of cell (idx, c) for one of the supported methods.

    ``const``: ``value``; ``random``: hash uniform; ``lcg``: integer recurrence;
    ``diagonal``: ``value`` where idx == c else 0; ``diagonal_random``: diagonal
    on the first ``diag_rows`` rows, hash uniform below.
    """
    if method == "const":
        return F.lit(float(value))
    if method == "random":
        return hash_uniform(idx, c, tensor, mode, seed)
    if method == "lcg":
        return lcg_uniform(idx, c, tensor, mode)
    if method == "diagonal":
        return F.when(idx == F.lit(c), F.lit(float(value))).otherwise(F.lit(0.0))
    if method == "diagonal_random":
        if diag_rows is None:
            raise ValueError("diagonal_random needs diag_rows")
        diag = F.when(idx == F.lit(c), F.lit(float(value))).otherwise(F.lit(0.0))
        return F.when(idx < F.lit(int(diag_rows)), diag).otherwise(hash_uniform(idx, c, tensor, mode, seed))
    raise ValueError(f"unknown init method {method!r}")
