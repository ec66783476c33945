"""Cells over arrays against the kernels that go row by row."""

import numpy as np
import pytest

from brooklet import queries
from brooklet.operators.cells import CellKernel, Chains
from brooklet.operators.detectors import RSHash, XStream
from brooklet.operators.kernels import ChainKernel, HashKernel


@pytest.mark.parametrize("sketch", [{}, {"cms_w": 3, "cms_d": 11}])
def test_grids_in_runs(sketch):
    rng = np.random.default_rng(11)
    x = np.round(rng.random((900, 3)), 1)
    x[5, 0], x[300, 1], x[301, 1], x[302, 2] = np.inf, -np.inf, -np.inf, -1e300
    detector, t = RSHash(6, 70.5, seed=2, **sketch), np.arange(1.0, 901)
    plain, kernel = HashKernel(detector, 3), CellKernel(detector, 3)
    got = [v for part in np.array_split(np.arange(900), 5) for v in kernel.many(x[part], t[part])]
    assert np.allclose(got, plain.many(x, t)) and len(kernel.x) <= 71


@pytest.mark.parametrize("depth,sketch", [(4, {}), (4, {"cms_w": 2, "cms_d": 7}), (45, {})])
def test_chains_block_by_block(depth, sketch):
    rng = np.random.default_rng(12)
    detector = XStream(20, 3, 4, depth, seed=3, **sketch)
    x = np.round(rng.random((110, 2)), 1)
    kernel = ChainKernel(detector, ["u", "v"])
    plain = [kernel.step(row, i) for i, row in enumerate(x)]
    state, p = Chains(detector, None), x @ kernel.weights.T
    got = np.concatenate([state.block(b, p[20 * b : 20 * b + 20]) for b in range(6)])
    assert np.array_equal(got, plain, equal_nan=True)
    begun = Chains(detector, None)  # a run that begins later takes two blocks to catch up
    late = np.concatenate([begun.block(b, p[20 * b : 20 * b + 20]) for b in range(2, 6)])
    assert np.isnan(late[:40]).all() and np.array_equal(late[40:], got[80:])


def test_rows_are_shuffled_once(spark, sf):
    """Cells of a row were rows of a shuffle, so that a task held more with each row of the input."""
    for name in ("xstream", "xstream_cms", "rshash_exact", "rshash_cms"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Window" not in plan
