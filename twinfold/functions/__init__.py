"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from twinfold.functions.columns import (
    cell_names,
    cp_sum,
    entry_columns,
    index_columns,
    rhs_names,
    row_product,
    vector_columns,
)
from twinfold.functions.init import hash_uniform, init_value, lcg_uniform

__all__ = [
    "cell_names",
    "cp_sum",
    "entry_columns",
    "hash_uniform",
    "index_columns",
    "init_value",
    "lcg_uniform",
    "rhs_names",
    "row_product",
    "vector_columns",
]
