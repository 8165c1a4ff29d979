"""Epochs over packed rows."""

import numpy as np
import pytest

from flowsentry.operators import mlp


def test_epochs_read_packed_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2), [float(v) for v in rng.random(3)]) for i in range(300)]
    train = spark.createDataFrame(rows, "id long, label int, features array<float>")
    table = mlp._training_table(train, "id", 42, 0.1, 2)
    found = table.collect()
    table.unpersist()
    assert len(found) == 2 and sum(r.n for r in found) == 300
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(r.n, -1) for r in found])
    assert sorted(map(tuple, x.tolist())) == sorted(tuple(np.float32(r[2]).tolist()) for r in rows)
    assert sum(np.frombuffer(r.is_val, bool).sum() for r in found) == 30


def test_steps_in_place_are_those_of_adam():
    rng = np.random.default_rng(6)
    layers = [3, 4, 1]
    w = mlp.initial_weights(layers, 1).astype(np.float32)
    m = v = np.zeros_like(w)
    adam = mlp.Adam(w, m, v, layers, 1e-3, 0.01)
    for t in range(1, 6):
        x, y = rng.random((8, 3)).astype(np.float32), rng.integers(0, 2, 8).astype(np.float32)
        cost, g = mlp.gradient(x, y, mlp.unpack(w, layers), 1e-3)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(0.01 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)) * m / (np.sqrt(v) + np.float32(1e-8))
        assert adam.step(x, y, t) == pytest.approx(cost, rel=1e-5)
        assert np.allclose(adam.weights, w, atol=1e-6)
