"""Labels of connected nodes against union-find."""

import numpy as np
import pytest

from corpusloom.llm.links import least_labels


def by_union(n, a, b):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (0, 3)], [(1, 2), (1, 3), (2, 4), (0, 4)]])
def test_shared_root_is_lowered(edges):
    a, b = np.array(edges).T
    assert (least_labels(int(b.max()) + 1, a, b) == 0).all()


def test_random_paths_trees_and_graphs():
    rng = np.random.default_rng(1)
    for k in range(600):
        n = int(rng.integers(2, 60))
        names = rng.permutation(n)
        if k % 3 == 0:
            a, b = names[:-1], names[1:]
        elif k % 3 == 1:
            a, b = names[1:], names[[int(rng.integers(0, i)) for i in range(1, n)]]
        else:
            a, b = rng.integers(0, n, (2, n // 2 + 1))
        order = rng.permutation(len(a))
        a, b = a[order], b[order]
        assert least_labels(n, a, b).tolist() == by_union(n, a.tolist(), b.tolist())
