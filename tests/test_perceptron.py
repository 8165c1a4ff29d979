"""The perceptron trained over packed rows: the library's loss, start and path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import classifiers, perceptron
from flowsentry.operators.mlp import unpack

LAYERS = [3, 5, 4, 2]


@pytest.fixture(scope="module")
def train(spark):
    rows = spark.range(0, 600, numPartitions=3).select(
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000).cast("float") for j in range(3)]).alias("features"))
    return rows.withColumn("label", (F.col("features")[0] + F.col("features")[1] > 1).cast("int")).cache()


def mean_loss(train, weights, layers):
    rows = train.collect()
    x, y = np.array([r.features for r in rows], np.float64), np.array([r.label for r in rows], np.int8)
    return perceptron.loss_and_gradient(x, y, unpack(weights, layers))[0] / len(rows)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    x, y = rng.random((40, 3)), rng.integers(0, 2, 40).astype(np.int8)
    weights = rng.normal(size=sum(a * b + b for a, b in zip(LAYERS, LAYERS[1:])))
    found = np.concatenate([g.ravel() for g in perceptron.loss_and_gradient(x, y, unpack(weights, LAYERS))[1]])
    for i in range(len(weights)):
        ends = [perceptron.loss_and_gradient(x, y, unpack(weights + s * (np.arange(len(weights)) == i), LAYERS))[0] for s in (-1e-6, 1e-6)]
        assert found[i] == pytest.approx((ends[1] - ends[0]) / 2e-6, abs=1e-5)


def test_starts_and_goes_as_the_library(train):
    start, own_start = (classifiers.fit_mlp(train, (5, 4), 0, solver=s).model.weights.toArray() for s in ("library", "scans"))
    assert (start == own_start).all()
    for iterations in (3, 8):
        library, own = (mean_loss(train, classifiers.fit_mlp(train, (5, 4), iterations, solver=s).model.weights.toArray(), LAYERS)
                        for s in ("library", "scans"))
        assert own < mean_loss(train, start, LAYERS)
        assert own == pytest.approx(library, rel=0.2)


def test_scores_like_the_library_and_learns(train):
    model = classifiers.fit_mlp(train, (8,), 60)
    scored = model.attach(train, "score", "prediction")
    assert scored.filter("label = prediction").count() > 570
    row = scored.head()
    p, (w, b, v, c) = np.array(row.features, float), unpack(model.model.weights.toArray(), [3, 8, 2])
    z = (1 / (1 + np.exp(-(p @ w + b)))) @ v + c
    assert row.score == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-9)


def test_missing_labels_and_numbers_are_refused(train):
    for odd in (train.withColumn("label", F.lit(None).cast("int")),
                train.withColumn("features", F.array(*[F.lit(float("nan")).cast("float")] * 3))):
        with pytest.raises(Exception):
            classifiers.fit_mlp(odd, (3,), 2)
