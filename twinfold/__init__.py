"""twinfold: coupled matrix and tensor factorisation as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# The Arrow UDFs (batched solve, Gram runs) are defined in this package.
# Pickle its functions by value so executors need no installed copy of it.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package with --py-files
    pass
