"""The ReLU network trained with Adam, data-parallel over the partitions of a table.

One Spark job per epoch. Each task starts from the current weights, runs mini-batch Adam
over its own rows and returns weights, moments and row count; the averages, weighted by
rows, start the next epoch. Rows stream through Arrow batches, so a task never holds its
partition. Rows set aside for validation are scored in the same job.

Averaging needs some steps between two averages to come near to what one worker learns, so the
number of workers follows from the number of rows: one for every ROWS_PER_TASK, TASKS at most. A
single worker has few rows, which it holds, and trains many epochs in a job.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.functions.arrow import matrix, sum_over_tasks, vector_batch
from flowsentry.functions.columns import apply_threshold, col, hash_order
from flowsentry.functions.session import materialise, write_json
from flowsentry.operators.sampling import hash_cutoffs

# The network's architecture and training settings.
ARCHITECTURE = {
    "hidden_layers": [128, 64], "activation": "relu", "optimizer": "adam", "batch_size": 256,
    "learning_rate_init": 0.001, "maximum_epochs": 150, "early_stopping": True,
    "validation_fraction": 0.1, "n_iter_no_change": 10,
}
# Candidate penalties.
ALPHA_VALUES = (1e-5, 1e-4, 1e-3, 1e-2)
# Workers that train side by side between two averagings: one for so many rows, and at most so many.
# The trained weights depend on their number and on nothing else of the cluster; it is stored with the model.
ROWS_PER_TASK, TASKS = 16_384, 64
EPOCHS_PER_JOB = 50  # of a single worker
ROWS_AT_ONCE = 10_000  # that are shuffled into mini-batches together
PACKED = "n int, x binary, y binary, is_val binary"  # float32, int8 and boolean values
BETA1, BETA2, EPSILON, TOLERANCE = 0.9, 0.999, 1e-8, 1e-4
TOTALS = 5  # rows, rows * steps, loss, validation rows, correct validation rows


def shapes(layers: list[int]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(layers, layers[1:]) for s in ((a, b), (b,))]


def unpack(flat: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in shapes(layers):
        size = math.prod(shape)
        parts.append(flat[at:at + size].reshape(shape))
        at += size
    return parts


def initial_weights(layers: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers, layers[1:]):
        bound = math.sqrt((6.0 if b != layers[-1] else 2.0) / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(x: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Activations of every layer; the last one is the attack probability."""
    layers = [x]
    last = len(parts) // 2 - 1
    for i in range(last + 1):
        z = layers[-1] @ parts[2 * i] + parts[2 * i + 1]
        layers.append(np.maximum(z, 0) if i < last else 1 / (1 + np.exp(-np.clip(z, -80, 80))))
    return layers


def gradient(x: np.ndarray, y: np.ndarray, parts: list[np.ndarray], alpha: float):
    activations = forward(x, parts)
    p = np.clip(activations[-1][:, 0], 1e-7, 1 - 1e-7)
    loss = -float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
    delta = (activations[-1] - y[:, None]) / len(y)
    grads: list[np.ndarray] = []
    for i in reversed(range(len(parts) // 2)):
        grads = [activations[i].T @ delta + alpha / len(y) * parts[2 * i], delta.sum(0), *grads]
        if i:
            delta = (delta @ parts[2 * i].T) * (activations[i] > 0)
    return loss, np.concatenate([g.ravel() for g in grads])


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in, a row of arrays as bytes out for every ROWS_AT_ONCE of them, in their order."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = (matrix(batch.column("features")), batch.column("label").to_numpy(zero_copy_only=False),
               batch.column("is_val").to_numpy(zero_copy_only=False))
        held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
        while len(held[0]) >= ROWS_AT_ONCE:
            yield packed_rows(*(p[:ROWS_AT_ONCE] for p in held))
            held = tuple(p[ROWS_AT_ONCE:] for p in held)
    if held is not None and len(held[0]):
        yield packed_rows(*held)


def packed_rows(x: np.ndarray, y: np.ndarray, val: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "n": pa.array([len(y)], pa.int32()), "x": pa.array([x.astype(np.float32).tobytes()], pa.binary()),
        "y": pa.array([y.astype(np.int8).tobytes()], pa.binary()), "is_val": pa.array([val.astype(bool).tobytes()], pa.binary())})


def unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and validation marks of every packed row."""
    for batch in batches:
        for n, x, y, val in zip(*(batch.column(c) for c in ("n", "x", "y", "is_val"))):
            yield (np.frombuffer(x.as_buffer(), np.float32).reshape(n.as_py(), -1),
                   np.frombuffer(y.as_buffer(), np.int8).astype(np.float32), np.frombuffer(val.as_buffer(), bool))


class Adam:
    """Mini-batch steps on weights and moments, which it changes in place."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, square: np.ndarray, layers: list[int], alpha: float, rate: float):
        self.weights, self.mean, self.square = (p.astype(np.float32) for p in (weights, mean, square))
        self.parts = unpack(self.weights, layers)
        self.alpha, self.rate = alpha, rate
        self.room = np.empty_like(self.weights)

    def step(self, x: np.ndarray, y: np.ndarray, number: int) -> float:
        """The ``number``-th step since the start, on one mini-batch; its loss."""
        cost, g = gradient(x, y, self.parts, self.alpha)
        room = self.room
        np.multiply(g, 1 - BETA1, out=room)
        self.mean *= BETA1
        self.mean += room
        np.multiply(g, 1 - BETA2, out=room)
        room *= g
        self.square *= BETA2
        self.square += room
        np.sqrt(self.square, out=room)
        room += np.float32(EPSILON)
        scale = np.float32(self.rate * math.sqrt(1 - BETA2 ** number) / (1 - BETA1 ** number))
        np.divide(np.multiply(self.mean, scale, out=g), room, out=room)
        self.weights -= room
        return cost


def epoch_task(state: np.ndarray, steps: int, layers: list[int], alpha: float, rate: float,
               batch_size: int, seed: int):
    """The mapInArrow function of one epoch: a task's rows in, one row of results out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam = Adam(*state.reshape(3, -1), layers, alpha, rate)
        start = unpack(adam.weights.copy(), layers)
        rng = np.random.default_rng(seed)
        n = val_n = val_correct = taken = 0
        loss = 0.0
        for x, y, val in unpacked_rows(batches):
            if val.any():
                val_n += int(val.sum())
                val_correct += int(((forward(x[val], start)[-1][:, 0] >= 0.5) == y[val]).sum())
            x, y = x[~val], y[~val]
            order = rng.permutation(len(y))
            n += len(y)
            for at in range(0, len(y), batch_size):
                rows = order[at:at + batch_size]
                taken += 1
                loss += adam.step(x[rows], y[rows], steps + taken)
        totals = [n, n * taken, loss, val_n, val_correct]
        moved = np.concatenate([adam.weights, adam.mean, adam.square])
        yield vector_batch(np.concatenate([totals, moved.astype(np.float64) * n]))

    return run


@dataclass
class Progress:
    """Where a single worker stands between two jobs."""

    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    best_weights: np.ndarray
    steps: int = 0
    epoch: int = 0
    best: float = -1.0
    waited: int = 0
    history: list[tuple[float, float]] = field(default_factory=list)  # loss, validation accuracy

    def packed(self) -> np.ndarray:
        numbers = [self.steps, self.epoch, self.best, self.waited, len(self.weights)]
        return np.concatenate([numbers, self.weights, self.mean, self.square, self.best_weights, np.ravel(self.history)])

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Progress:
        steps, epoch, best, waited, size = flat[:5]
        parts, rest = flat[5:5 + 4 * int(size)].reshape(4, -1), flat[5 + 4 * int(size):]
        history = [tuple(pair) for pair in rest.reshape(-1, 2).tolist()]
        return cls(*parts.astype(np.float32), int(steps), int(epoch), float(best), int(waited), history)


def single_task(state: np.ndarray, layers: list[int], alpha: float, rate: float, batch_size: int, seed: int,
                last_epoch: int, patience: int):
    """The mapInArrow function of a single worker: all rows in, its progress after some epochs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(unpacked_rows(batches))
        if not rows:
            return
        x, y, val = (np.concatenate(part) for part in zip(*rows))
        held, x, y = (x[val], y[val]), x[~val], y[~val]
        now = Progress.unpacked(state)
        adam = Adam(now.weights, now.mean, now.square, layers, alpha, rate)
        while now.epoch < last_epoch and now.waited < patience:
            order, cost = np.random.default_rng(seed + now.epoch).permutation(len(y)), 0.0
            for at in range(0, len(y), batch_size):
                mine = order[at:at + batch_size]
                now.steps += 1
                cost += adam.step(x[mine], y[mine], now.steps)
            now.weights, now.mean, now.square = adam.weights.copy(), adam.mean, adam.square
            right = (forward(held[0], unpack(now.weights, layers))[-1][:, 0] >= 0.5) == held[1] if len(held[1]) else np.zeros(1)
            accuracy = float(np.mean(right))
            now.epoch += 1
            now.history.append((cost / max(1, len(y)), accuracy))
            now.waited = 0 if accuracy > now.best + TOLERANCE else now.waited + 1
            if accuracy > now.best:
                now.best, now.best_weights = accuracy, now.weights
        yield vector_batch(now.packed())

    return run


def _fit_alone(table: DataFrame, layers: list[int], weights: np.ndarray, max_epochs: int, patience: int, **training) -> NetworkModel:
    zeros = np.zeros(len(weights))
    now = Progress(weights, zeros, zeros, weights)
    while now.epoch < max_epochs and now.waited < patience:
        task = single_task(now.packed(), layers, last_epoch=min(max_epochs, now.epoch + EPOCHS_PER_JOB), patience=patience, **training)
        now = Progress.unpacked(sum_over_tasks(table, task, 1))
    history = [{"epoch": k, "loss": float(loss), "validation_score": float(score)}
               for k, (loss, score) in enumerate(now.history, 1)]
    return NetworkModel(layers, now.best_weights.astype(np.float64), history=history, epochs_completed=now.epoch,
                        best_validation_score=max(0.0, now.best), tasks=1)


@dataclass
class NetworkModel:
    """A trained network; scoring runs over whole Arrow batches."""

    layers: list[int]
    weights: np.ndarray
    threshold: float = 0.5
    history: list[dict] = field(default_factory=list)
    epochs_completed: int = 0
    best_validation_score: float = 0.0
    tasks: int = 1

    def attach(self, df: DataFrame, score: str, label: str) -> DataFrame:
        layers, weights = self.layers, self.weights.astype(np.float32)

        @F.arrow_udf("double")
        def probability(features: pa.Array) -> pa.Array:
            if len(features) == 0:
                return pa.array([], pa.float64())
            scores = forward(matrix(features), unpack(weights, layers))[-1][:, 0]
            return pa.array(scores.astype(np.float64))

        return df.withColumn(score, probability("features")).withColumn(
            label, apply_threshold(F.col(score), self.threshold))

    def training_history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.epochs_completed, self.best_validation_score)],
            "epochs_completed int, best_validation_score double")

    def epoch_history(self, spark: SparkSession) -> DataFrame:
        rows = [(h["epoch"], h["loss"], h["validation_score"]) for h in self.history]
        return spark.createDataFrame(rows, "epoch int, loss double, validation_score double")

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, path + "/kind", {
            "kind": "network", "layers": self.layers, "threshold": self.threshold,
            "weights": base64.b64encode(self.weights.tobytes()).decode(),
            "history": self.history, "epochs_completed": self.epochs_completed,
            "best_validation_score": self.best_validation_score, "tasks": self.tasks,
        })

    @classmethod
    def from_document(cls, d: dict) -> NetworkModel:
        weights = np.frombuffer(base64.b64decode(d["weights"]))
        return cls(d["layers"], weights, d["threshold"], d["history"], d["epochs_completed"],
                   d["best_validation_score"], d["tasks"])


def tasks_for(rows: int) -> int:
    """Workers for a table of so many rows."""
    return max(1, min(TASKS, rows // ROWS_PER_TASK))


def _training_table(train: DataFrame, key: str, seed: int, fraction: float, tasks: int) -> DataFrame:
    """Training rows with a validation mark, in ``tasks`` partitions, each in hashed order.

    A row's partition and place follow from its key alone. The table is written once; the
    partitions are kept by the executors, packed into arrays so that an epoch makes no Arrow rows
    anew, and rebuilt from it if one is lost.
    """
    order = hash_order(col(key), seed, "validate")
    cutoffs = hash_cutoffs(
        train, order, F.col("label"),
        lambda n: {c: [round(s * fraction)] for c, s in n.items()},
    )
    is_val = F.lit(False)
    for c, cuts in cutoffs.items():
        is_val = is_val | ((F.col("label") == F.lit(c)) & (order <= F.lit(cuts[0])))
    marked = train.select(
        "features", F.col("label").cast("int").alias("label"), is_val.alias("is_val"),
        hash_order(col(key), seed, "shuffle").alias("h"))
    table = materialise(marked, "network-training")
    placed = table.repartitionById(tasks, F.pmod(F.xxhash64("h"), F.lit(tasks)).cast("int"))
    packed = placed.sortWithinPartitions("h").drop("h").mapInArrow(pack_rows, PACKED)
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def fit_mlp_adam(
    train: DataFrame, key: str, alpha: float = 1e-4, seed: int = 42,
    hidden: tuple[int, ...] = tuple(ARCHITECTURE["hidden_layers"]),
    max_epochs: int = ARCHITECTURE["maximum_epochs"],
    batch_size: int = ARCHITECTURE["batch_size"],
    learning_rate: float = ARCHITECTURE["learning_rate_init"],
    validation_fraction: float = ARCHITECTURE["validation_fraction"],
    patience: int = ARCHITECTURE["n_iter_no_change"],
    tasks: int | None = None,
) -> NetworkModel:
    """Train until the validation accuracy has not improved for ``patience`` epochs.

    ``tasks`` is the number of parallel workers, by default as many as the rows keep busy; the
    same number gives the same weights on any cluster. The driver only ever holds weights, which
    do not grow with the data.
    """
    tasks = tasks_for(train.count()) if tasks is None else tasks
    table = _training_table(train, key, seed, validation_fraction, tasks)
    layers = [len(train.select("features").head().features), *hidden, 1]
    weights = initial_weights(layers, seed)
    if tasks == 1:
        model = _fit_alone(table, layers, weights, max_epochs, patience, alpha=alpha, rate=learning_rate,
                           batch_size=batch_size, seed=seed)
        table.unpersist()
        return model
    state = np.concatenate([weights, np.zeros(2 * len(weights))])
    model = NetworkModel(layers, weights, tasks=tasks)
    best, best_weights, waited, steps = -1.0, weights, 0, 0
    # Job e scores the weights that epoch e-1 produced, so one more job ends the last epoch.
    for epoch in range(max_epochs + 1):
        run = epoch_task(state, steps, layers, alpha, learning_rate, batch_size, seed + epoch)
        sums = sum_over_tasks(table, run, tasks)
        n, weighted_steps, cost, val_n, val_correct = sums[:TOTALS]
        accuracy = val_correct / val_n if val_n else 0.0
        if epoch:
            model.history.append(
                {"epoch": epoch, "loss": float(loss), "validation_score": float(accuracy)})
            model.epochs_completed = epoch
            waited = 0 if accuracy > best + TOLERANCE else waited + 1
            if accuracy > best:
                best, best_weights = accuracy, state.reshape(3, -1)[0]
            if waited >= patience:
                break
        loss = cost / n
        state = sums[TOTALS:] / n
        steps += round(weighted_steps / n)
    table.unpersist()
    model.weights, model.best_validation_score = np.array(best_weights), float(best)
    return model
