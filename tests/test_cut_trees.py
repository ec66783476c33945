"""Cut trees: boxes and masses after random changes, and what a row costs."""

import numpy as np

from brooklet.operators.kernels import CutTree, CutTreeKernel


class Counted:
    def __init__(self, seed):
        self.rng, self.calls = np.random.default_rng(seed), 0

    def random(self, *size):
        self.calls += 1
        return self.rng.random(*size)


def _checked(node, parent=None):
    """Rows below a node; boxes are those of the rows, masses their numbers."""
    assert node[0] is parent
    if node[4] < 0:
        assert node[2] == node[3]
        return [tuple(node[2])] * node[1]
    one, two = _checked(node[6], node), _checked(node[7], node)
    rows = one + two
    assert node[1] == len(rows) and node[2] == np.min(rows, 0).tolist() and node[3] == np.max(rows, 0).tolist()
    assert all(r[node[4]] <= node[5] for r in one) and all(r[node[4]] > node[5] for r in two)
    return rows


def test_boxes_and_draws():
    rng, kernel = np.random.default_rng(1), CutTreeKernel(40, 2)
    kernel.tree = CutTree(Counted(2))
    rows = np.round(rng.random((600, 3)), 1)
    for i, row in enumerate(rows):
        kernel.step(row, float(i))
        assert sorted(_checked(kernel.tree.root)) == sorted(map(tuple, rows[max(0, i - 39) : i + 1].tolist()))
    assert kernel.tree.rng.calls < 600  # draws are taken many at once
