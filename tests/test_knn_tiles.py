"""Queries meet tiles of a block: the same rows as brute force, without a distance for every pair."""

import tracemalloc

import numpy as np
import pytest

from flowsentry.operators.knn import nearest


def block(rows, width, steps, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.integers(0, steps, (rows, width)) / steps).astype(np.float32).astype(float)
    return x, rng.permutation(rows).astype(np.int64), rng.integers(0, 2, rows).astype(np.int32)


def brute(q, bound, x, ids, k):
    found = []
    for row, point in enumerate(q):
        d2 = np.zeros(len(x))
        for j in range(x.shape[1]):
            d2 += (point[j] - x[:, j]) ** 2
        best = [i for i in np.lexsort((ids, d2)) if d2[i] <= bound[row]][:k]
        found += [(row, d2[i], int(ids[i])) for i in best]
    return found


@pytest.mark.parametrize("rows, width, steps, k", [(700, 3, 8, 5), (1000, 2, 1000, 15), (300, 1, 3, 60), (4, 3, 10, 5), (600, 3, 1, 2)])
def test_nearest_equals_brute_force(rows, width, steps, k):
    x, ids, labels = block(rows, width, steps)
    q = block(150, width, steps, 2)[0] * 1.5 - 0.2
    for bound in (np.full(len(q), np.inf), np.where(np.arange(len(q)) % 3 == 0, np.inf, 0.05)):
        hits = nearest(q, bound, x, ids, labels, k)
        assert [(int(h["row"]), float(h["d2"]), int(h["id"])) for h in hits] == brute(q, bound, x, ids, k)
        assert (labels[np.argsort(ids)][hits["id"]] == hits["label"]).all()


def test_bounded_queries_do_not_meet_every_row():
    x, ids, labels = block(4096, 3, 1 << 20)
    q = block(8192, 3, 1 << 20, 2)[0]
    bound = np.full(len(q), 1e-3)
    nearest(q[:10], bound[:10], x, ids, labels, 5)
    tracemalloc.start()
    nearest(q, bound, x, ids, labels, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8192 * 4096 * 8 / 16  # an eighth of the pairs' distances, twice
