"""Compositions of operators: the fit loop, the job entry and the query catalogue."""
