"""Observers at equal distances."""

import numpy as np

from brooklet.operators import kernels as ker
from tests.test_kernels import _observers


def test_equal_distances_go_to_the_more_observed():
    rows = np.random.default_rng(4).integers(0, 9, (2500, 1)).astype(float).tolist()
    kernel = ker.SDOstream(12, 60, 0.3, 4, seed=1).kernel()
    want = _observers([tuple(r) for r in rows], 12, 60, 0.3, 4, np.random.default_rng(1).random(len(rows)))
    got = [kernel.step(np.array(r), i + 1) for i, r in enumerate(rows)]
    assert [g[1] for g in got] == [w[1] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want])
