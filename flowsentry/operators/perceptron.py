"""Training of the sigmoid perceptron by L-BFGS over packed rows.

Every evaluation of the loss is one scan: tasks add up loss and gradient of their rows, a few thousand at a
time by matrix products, and the driver holds weights and the last steps only. Loss, starting weights and
stopping rules are those of Spark ML's perceptron; only the order of summation differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsentry.functions.arrow import sum_over_tasks, vector_batch
from flowsentry.functions.session import materialise, release
from flowsentry.operators.mlp import unpack
from flowsentry.operators.newton import PACKED, pack_rows

ROWS_TOGETHER = 1_024  # whose activations stay in the cache
CORRECTIONS, TOLERANCE, VALUES_KEPT = 10, 1e-6, 20
SUFFICIENT, CURVATURE, TRIALS = 1e-4, 0.9, 20  # of the strong Wolfe conditions


def loss_and_gradient(x: np.ndarray, y: np.ndarray, parts: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Summed cross entropy of some rows (softmax on top of sigmoid layers) and its gradient by part."""
    last = len(parts) // 2 - 1
    layers = [x]
    for i in range(last + 1):
        z = layers[-1] @ parts[2 * i]
        z += parts[2 * i + 1]
        if i < last:
            np.negative(z, out=z)
            np.exp(np.minimum(z, 700, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
        layers.append(z)
    z = layers.pop()
    z -= z.max(axis=1, keepdims=True)
    rows = np.arange(len(y))
    right = z[rows, y]
    delta = np.exp(z, out=z)
    total = delta.sum(axis=1, keepdims=True)
    loss = float(np.log(total).sum() - right.sum())
    delta /= total
    delta[rows, y] -= 1
    gradients: list[np.ndarray] = []
    for i in reversed(range(last + 1)):
        gradients = [layers[i].T @ delta, delta.sum(axis=0), *gradients]
        if i:
            delta = delta @ parts[2 * i].T
            delta *= layers[i]
            delta *= np.subtract(1, layers[i], out=layers[i])
    return loss, gradients


def gradient_task(weights: np.ndarray, layers: list[int]):
    """The mapInArrow function of one evaluation: packed rows in; rows, loss and gradient summed out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = unpack(weights, layers), np.zeros(2 + len(weights))
        sums = unpack(total[2:], layers)
        for batch in batches:
            for packed_x, packed_y in zip(batch.column("x"), batch.column("y")):
                x = np.frombuffer(packed_x.as_buffer(), np.float32).reshape(-1, layers[0])
                y = np.frombuffer(packed_y.as_buffer(), np.int8)
                for at in range(0, len(y), ROWS_TOGETHER):
                    some = x[at:at + ROWS_TOGETHER].astype(np.float64)
                    loss, gradients = loss_and_gradient(some, y[at:at + ROWS_TOGETHER], parts)
                    total[:2] += len(some), loss
                    for own, found in zip(sums, gradients):
                        own += found
        yield vector_batch(total)

    return run


def descent(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """The direction of L-BFGS: minus the gradient times the curvature that the last steps have shown."""
    direction, shares = -gradient, []
    for s, c in zip(reversed(steps), reversed(changes)):
        share = s @ direction / (s @ c)
        shares.append(share)
        direction = direction - share * c
    if steps:
        direction = direction * (steps[-1] @ changes[-1] / (changes[-1] @ changes[-1]))
    for s, c, share in zip(steps, changes, reversed(shares)):
        direction = direction + (share - c @ direction / (s @ c)) * s
    return direction


def wolfe_step(at: Callable, value: float, slope: float, step: float):
    """A step along a direction that meets the strong Wolfe conditions, as (step, value, gradient).

    ``at`` gives value, slope and gradient at a step. Once the minimum is enclosed the enclosure is cut where a
    cubic has its minimum. None if TRIALS evaluations find no such step.
    """
    low, high = (0.0, value, slope), None
    for _ in range(TRIALS):
        found, found_slope, gradient = at(step)
        if not np.isfinite(found) or found > value + SUFFICIENT * step * slope or found >= low[1] and low[0] > 0:
            high = (step, found, found_slope)
        elif abs(found_slope) <= -CURVATURE * slope:
            return step, found, gradient
        else:
            if found_slope * ((high[0] if high else np.inf) - low[0]) >= 0:
                high = low
            low = (step, found, found_slope)
        if high is None:
            step *= 1.5
            continue
        wide = high[0] - low[0]
        with np.errstate(all="ignore"):
            bend = low[2] + high[2] - 3 * (high[1] - low[1]) / wide
            root = np.sign(wide) * np.sqrt(bend * bend - low[2] * high[2])
            step = high[0] - wide * (high[2] + root - bend) / (high[2] - low[2] + 2 * root)
        inside = sorted((low[0] + 0.1 * wide, high[0] - 0.1 * wide))
        if not inside[0] <= step <= inside[1]:
            step = low[0] + wide / 2
    return None


def fit_weights(train: DataFrame, layers: list[int], weights: np.ndarray, max_iter: int) -> np.ndarray:
    """The trained weights, from (features, label, fold) rows and starting weights."""
    rows = materialise(train.mapInArrow(pack_rows, PACKED), "perceptron-rows", spread=True)
    parts = rows.rdd.getNumPartitions()

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray]:
        sums = sum_over_tasks(rows, gradient_task(point, layers), parts)
        return float(sums[1] / sums[0]), sums[2:] / sums[0]

    value, gradient = evaluate(weights)
    if not np.isfinite(value):
        raise ValueError("features must be finite numbers")
    first, values = value, [value]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    for number in range(max_iter):
        if np.linalg.norm(gradient) <= max(TOLERANCE * value, 1e-8):
            break
        direction = descent(gradient, steps, changes)

        def at(step: float, start=weights, direction=direction):
            found, there = evaluate(start + step * direction)
            return found, float(there @ direction), there

        taken = wolfe_step(at, value, float(gradient @ direction), 1 / np.linalg.norm(direction) if number == 0 else 1.0)
        if taken is None and not steps:
            break
        if taken is None:  # start again along the gradient
            steps, changes = [], []
            continue
        step, value, there = taken
        steps, changes = [*steps, step * direction][-CORRECTIONS:], [*changes, there - gradient][-CORRECTIONS:]
        weights, gradient = weights + step * direction, there
        if max(values) - value <= TOLERANCE * first:
            break
        values = [*values, value][-VALUES_KEPT:]
    release(rows)
    return weights
