"""Edge cases on small fixtures, checked against the dense NumPy model (brute force)."""

import numpy as np
import pytest

import numpy_model as nm
from test_fit import _model_factors, _np_inputs
from twinfold.plans.fit import fit
from twinfold.spec import Coupling, FitConfig, Options, Stop, Tensor


def _fixture(spark):
    rng = np.random.default_rng(5)
    rows_a = []
    # hot key: i0 = 0 holds a third of tensor A's cells
    for _ in range(20):
        rows_a.append((0, int(rng.integers(0, 4)), float(rng.uniform(0, 3))))
    for _ in range(40):
        rows_a.append((int(rng.integers(1, 5)), int(rng.integers(0, 4)), float(rng.uniform(0, 3))))
    rows_a += [(1, 1, 0.0), (2, 3, 0.0)]            # explicit zeros
    rows_a += [(3, 2, 1.5), (3, 2, 2.5)]            # duplicate coordinate
    # i0 = 5 has no entry; coupled key 4 is seen only in tensor B
    rows_b = [(int(rng.integers(0, 4)), int(rng.integers(0, 5)), float(rng.uniform(0, 2))) for _ in range(25)]
    rows_b.append((0, 4, 1.0))
    a = Tensor(spark.createDataFrame(rows_a, "i0 long, i1 long, y double"), (6, 5), "a")
    b = Tensor(spark.createDataFrame(rows_b, "i0 long, i1 long, y double"), (4, 5), "b")
    return a, b


@pytest.mark.parametrize("rank,common,method", [(3, 2, "auto"), (3, 2, "gram"), (2, 2, "auto"), (3, 0, "auto")])
def test_edge_fixture_matches_numpy(spark, rank, common, method):
    a, b = _fixture(spark)
    cfg = FitConfig(rank=rank, common=common, options=Options(0.2, "ls"), stop=Stop(max_iter=2), init="lcg",
                    method=method, partition_bytes=240)
    model = fit(spark, [a, b], [Coupling(0, 1, 1, 1)], cfg)
    arrs, F = _np_inputs(spark, [a, b], rank)
    init5 = {k: v.copy() for k, v in F.items()}
    for _ in range(2):
        nm.sweep(arrs, F, 1, rank, common, 0.2, "ls")
    got = _model_factors(model)
    for k in F:
        np.testing.assert_allclose(got[k], F[k], rtol=1e-7, atol=1e-9)
    # a row without entries keeps its initial value; the one-sided coupled key keeps tensor A's common block
    np.testing.assert_allclose(got[(0, 0)][5], init5[(0, 0)][5])
    if common:
        np.testing.assert_allclose(got[(0, 1)][4][:common], init5[(0, 1)][4][:common])


def test_out_of_range_index_is_refused(spark):
    a, b = _fixture(spark)
    bad = Tensor(a.entries.union(spark.createDataFrame([(9, 0, 1.0)], a.entries.schema)), a.dims, "bad")
    with pytest.raises(ValueError, match="outside"):
        fit(spark, [bad, b], [Coupling(0, 1, 1, 1)], FitConfig(rank=2, common=1, stop=Stop(max_iter=1)))


def test_share_init_starts_common_blocks_equal(spark):
    a, b = _fixture(spark)
    cfg = FitConfig(rank=2, common=1, stop=Stop(max_iter=1), share_init=True, init="lcg")
    model = fit(spark, [a, b], [Coupling(0, 1, 1, 1)], cfg)
    fa = {r.idx: r.v for r in model.factor(0, 1).collect()}
    fb = {r.idx: r.v for r in model.factor(1, 1).collect()}
    for k in fa:
        assert fa[k][0] == pytest.approx(fb[k][0])
