"""Linear classifiers by Newton's method, many problems per scan.

A flow has few features, so the gradient and the curvature of a linear model fit in one
small matrix. Each scan of the training table sums both for every problem at hand - all
penalties and all folds of a grid search together - and the driver solves the small
systems. A grid of 7 penalties over 3 folds takes about a dozen scans in all.

Objective: half the squared weights plus C times the summed loss; the intercept is free.
Losses: logistic, and the squared hinge for the support vector machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsentry.functions.arrow import matrix, sum_over_tasks, vector_batch
from flowsentry.functions.session import materialise, release

MAX_SCANS = 60
TOLERANCE = 1e-9
ROWS_AT_ONCE = 4096
FEW_BLOCKS = 64  # of packed rows, whose solutions larger tables start from
CELLS = 1 << 14  # scores of rows by problems computed at once, so that they stay in the cache
PACKED = "x binary, y binary, fold binary"  # float32, int8 and int32 values of up to ROWS_AT_ONCE rows
PACKED_ARROW = pa.schema([("x", pa.binary()), ("y", pa.binary()), ("fold", pa.binary())])


@dataclass(frozen=True)
class Problem:
    """A penalty, and the fold left out (None: all rows)."""

    c: float
    without_fold: int | None = None


@dataclass(frozen=True)
class Solution:
    """Weights per problem, whether each converged, and the scans taken."""

    weights: np.ndarray
    converged: np.ndarray
    scans: int


def with_intercept(x: np.ndarray) -> np.ndarray:
    return np.hstack([x.astype(np.float64), np.ones((len(x), 1))])


def losses(margin: np.ndarray, y: np.ndarray, kind: str):
    """Loss, first and second derivative by the score; y is 0/1."""
    if kind == "logistic":
        e = np.exp(-np.abs(margin))
        p = np.where(margin >= 0, 1.0, e) / (1 + e)
        return np.maximum(0, margin) + np.log1p(e) - y * margin, p - y, p * (1 - p)
    sign = 2 * y - 1
    gap = np.maximum(0, 1 - sign * margin)
    return gap * gap, -2 * sign * gap, 2.0 * (gap > 0)


def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in, a row of arrays as bytes out for every ROWS_AT_ONCE of a batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x, y = matrix(batch.column("features")), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int8)
        folds = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int32)
        yield pa.RecordBatch.from_pylist(
            [{"x": np.ascontiguousarray(x[at:at + ROWS_AT_ONCE], np.float32).tobytes(), "y": y[at:at + ROWS_AT_ONCE].tobytes(),
              "fold": folds[at:at + ROWS_AT_ONCE].tobytes()} for at in range(0, batch.num_rows, ROWS_AT_ONCE)], PACKED_ARROW)


@dataclass
class Packed:
    """Rows of a table as arrays, and by (loss, penalty) weights found over its folds, from which a fit of all
    rows starts."""

    rows: DataFrame
    starts: dict

    def release(self) -> None:
        release(self.rows)


def pack(table: DataFrame) -> Packed:
    """A table of (features, label, fold), written once as arrays."""
    return Packed(materialise(table.select("features", "label", "fold").mapInArrow(pack_rows, PACKED), "newton-rows", spread=True), {})


def scan_task(weights: np.ndarray, folds_out: list, kind: str):
    """Per problem: summed loss, gradient and curvature of a partition's packed rows.

    Rows are taken fold by fold, each by the problems that are fitted with it. They lie side by side, so that
    products of columns are of whole stretches of memory.
    """
    count, width = weights.shape
    out = np.array([-1 if f is None else f for f in folds_out])
    size = width * (width + 1) // 2
    step = min(ROWS_AT_ONCE, max(1536, CELLS // count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, 1 + width + size))
        x, products = np.ones((width, step)), np.empty((size, step))
        for batch in batches:
            for row in batch.to_pylist():
                features = np.frombuffer(row["x"], np.float32).reshape(-1, width - 1)
                labels, folds = np.frombuffer(row["y"], np.int8).astype(np.float64), np.frombuffer(row["fold"], np.int32)
                order = np.argsort(folds, kind="stable")
                for fold, first in zip(*np.unique(folds[order], return_index=True)):
                    mine, end = np.flatnonzero(out != fold), first + np.count_nonzero(folds == fold)
                    for at in range(first, end if len(mine) else first, step):
                        picked = order[at:min(at + step, end)]
                        part, pairs, begin = x[:, :len(picked)], products[:, :len(picked)], 0
                        part[:-1] = features[picked].T
                        for j in range(width):  # in the order of the upper triangle
                            np.multiply(part[j], part[j:], out=pairs[begin:begin + width - j])
                            begin += width - j
                        value, gradient, curvature = losses(weights[mine] @ part, labels[picked], kind)
                        total[mine] += np.column_stack([value.sum(1), gradient @ part.T, curvature @ pairs.T])
        yield vector_batch(total.ravel())

    return run


def solve(
    table: DataFrame, problems: Sequence[Problem], kind: str, max_scans: int = MAX_SCANS, packed: Packed | None = None,
) -> Solution:
    """Weights (intercept last) of every problem over a table of (features, label, fold).

    ``table`` is packed once into arrays, which are scanned about a dozen times. ``packed`` are its rows as
    ``pack`` gives them, where they are there already; these stay.

    A Newton step that does not lower a problem's objective is halved in the next scan;
    problems that have converged take no further part. Where a search has solved a penalty over the folds, a problem
    of all rows starts from there. Of a large table a few blocks are solved first, with penalties for their size, so
    that the whole takes a few scans; a problem that does not converge from there is started again from 0.
    """
    width = len(table.select("features").head().features) + 1
    held = pack(table) if packed is None else packed
    starts = {p: held.starts[kind, problem.c] for p, problem in enumerate(problems)
              if problem.without_fold is None and (kind, problem.c) in held.starts}
    blocks, left = held.rows.count(), [p for p in range(len(problems)) if p not in starts]
    if blocks >= 4 * FEW_BLOCKS and left:
        few = Packed(materialise(held.rows.sample(FEW_BLOCKS / blocks, 1), "newton-few", spread=True), {})
        share = blocks / max(1, few.rows.count())
        found = _solved(few, [Problem(problems[p].c * share, problems[p].without_fold) for p in left], kind, max_scans, width, {})
        starts |= {p: w for p, w, ok in zip(left, found.weights, found.converged) if ok}
        few.release()
    found = _solved(held, problems, kind, max_scans, width, starts)
    again = [p for p in starts if not found.converged[p]]
    if again:
        other = _solved(held, [problems[p] for p in again], kind, max_scans, width, {})
        found.weights[again], found.converged[again] = other.weights, other.converged
        found = Solution(found.weights, found.converged, found.scans + other.scans)
    if packed is None:
        held.release()
    for c in {problem.c for problem in problems}:
        held.starts[kind, c] = found.weights[[problem.c == c for problem in problems]].mean(axis=0)
    return found


def _solved(held: Packed, problems: Sequence[Problem], kind: str, max_scans: int, width: int, starts: dict) -> Solution:
    """Newton's method from the given weights, by problem, or from 0."""
    rows = held.rows
    parts = rows.rdd.getNumPartitions()
    upper = np.triu_indices(width)
    ridge = np.ones(width)
    ridge[-1] = 0
    best = np.zeros((len(problems), width))
    trial, step, value = best.copy(), best.copy(), np.full(len(problems), np.inf)
    for p, weights in starts.items():
        trial[p] = weights
    active, scans = list(range(len(problems))), 0
    while active and scans < max_scans:
        scans += 1
        task = scan_task(trial[active], [problems[p].without_fold for p in active], kind)
        sums = sum_over_tasks(rows, task, parts).reshape(len(active), -1)
        still = []
        for p, total in zip(active, sums):
            c, w = problems[p].c, trial[p]
            objective = c * total[0] + 0.5 * np.dot(ridge * w, w)
            if objective <= value[p]:
                gradient = c * total[1:1 + width] + ridge * w
                curvature = np.zeros((width, width))
                curvature[upper] = c * total[1 + width:]
                curvature = np.triu(curvature) + np.triu(curvature, 1).T + np.diag(ridge)
                curvature[np.diag_indices(width)] += 1e-10 * max(1.0, np.trace(curvature) / width)
                best[p], value[p] = w, objective
                step[p] = -np.linalg.solve(curvature, gradient)
                if -np.dot(step[p], gradient) / 2 <= TOLERANCE * (1 + abs(objective)):
                    continue
            else:
                step[p] /= 2
                if np.abs(step[p]).max() <= 1e-12 * (1 + np.abs(best[p]).max()):
                    continue
            trial[p] = best[p] + step[p]
            still.append(p)
        active = still
    converged = np.ones(len(problems), bool)
    converged[active] = False
    return Solution(best, converged, scans)


def held_out_task(weights: np.ndarray, folds_out: list):
    """Per problem: tn, fp, fn, tp over the packed rows of the fold it was fitted without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), 4))
        for batch in batches:
            for row in batch.to_pylist():
                x = with_intercept(np.frombuffer(row["x"], np.float32).reshape(-1, weights.shape[1] - 1))
                ones, folds = np.frombuffer(row["y"], np.int8) == 1, np.frombuffer(row["fold"], np.int32)
                cell = 2 * ones[:, None] + (x @ weights.T >= 0)
                for p, fold in enumerate(folds_out):
                    total[p] += np.bincount(cell[folds == fold, p], minlength=4)
        yield vector_batch(total.ravel())

    return run


def held_out_f1(packed: Packed, problems: Sequence[Problem], weights: np.ndarray) -> list[float]:
    """F1 of every problem on its own held-out fold, in one scan of packed rows."""
    task = held_out_task(weights, [p.without_fold for p in problems])
    counts = sum_over_tasks(packed.rows, task, packed.rows.rdd.getNumPartitions()).reshape(-1, 4)
    return [float(2 * tp / (2 * tp + fp + fn)) if tp + fp + fn else 0.0 for _, fp, fn, tp in counts]
