"""Whitening of embeddings by a bidiagonal qd solver.

* Two scans fit the model. The first one sums the rows exactly, as integers. In the second one each
  task reduces its centred rows block by block to a triangle R (QR of the triangle so far on top of
  the block), and triangles are merged the same way, in a tree where there are many. R'R is n times
  the covariance, which itself is never formed.
* R is brought to upper bidiagonal form B by Householder reflections from both sides.
* Singular values of B come from the differential quotient-difference algorithm with shifts (dqds).
* Eigenvectors of B'B come from twisted factorisations: the stationary transform from the top and the
  progressive one from the bottom meet at the row where they leave the smallest remainder. Vectors of
  neighbouring values are solved for repeatedly and kept orthogonal. The right reflections turn them
  into the whitening directions.

The triangle and the directions depend on the vectors' width alone (checked, MAX_WIDTH), never on the
number of rows; nothing is grouped, so repeated vectors weigh on no task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.session import spread_small

from .common import fresh

SCALE, OFFSET = 64, 1_000_000  # an entry c counts as floor(SCALE * c) + OFFSET
MAX_WIDTH = 4_096
BLOCK = 1_024  # rows that are reduced to a triangle at a time
TREE_WIDTH = 32  # beyond so many tasks their results are merged by tasks before the driver gets them
EPS = np.finfo(float).eps
CLUSTER = 1e-3  # values closer than this share of the largest keep their vectors orthogonal


# The dense solver, on one triangle of the vectors' width.

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and superdiagonal of U'RV, and the reflections (first place, unit vector) that make V."""
    a, size, right = r.astype(np.float64).copy(), len(r), []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        length = np.linalg.norm(x)
        if length == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        v = x / length
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(size):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < size - 2:
            v = reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                right.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """One transform; also the smallest remainder and its place. A negative one: the shift was too large."""
    size = len(q)
    new_q, new_e = np.empty(size), np.empty(size - 1)
    d = q[0] - shift
    least, place = d, 0
    for k in range(size - 1):
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift if new_q[k] else q[k + 1] - shift
        if not d >= least:  # also catches what is no number
            least, place = d, k + 1
    new_q[-1] = d
    return new_q, new_e, least, place


def _lowest_pair(q: np.ndarray, e: np.ndarray) -> tuple[float, float]:
    """Both eigenvalues of the last two rows' qd array, smaller one first."""
    total, product = q[-2] + q[-1] + e[-1], q[-2] * q[-1]
    root = math.sqrt(max(0.0, (total / 2) ** 2 - product))
    large = total / 2 + root
    return (product / large if large else 0.0), large


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, largest first, to high relative accuracy."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if scale == 0:
        return np.zeros(len(diagonal))
    parts, found = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)], []
    while parts:
        q, e, moved = parts.pop()
        while True:
            size = len(q)
            if size == 1:
                found.append(q[0] + moved)
                break
            if size == 2:
                found += [x + moved for x in _lowest_pair(q, e)]
                break
            small = e <= EPS ** 2 * (moved + np.minimum(q[:-1], q[1:]))
            if small[-1]:
                found.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            if small.any():
                at = int(np.flatnonzero(small)[-1]) + 1
                parts.append((q[:at], e[:at - 1], moved))
                q, e = q[at:], e[at:]
                continue
            if 1.5 * q[0] < q[-1]:  # small values should leave at the bottom
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = _lowest_pair(q[-2:], e[-1:])[0] * (1 - 4 * EPS)
            if q.min() <= EPS ** 2:
                shift = 0.0
            for attempt in range(4):
                new_q, new_e, least, place = _dqds_step(q, e, shift)
                if least >= 0:
                    break
                # A late failure tells how far the shift was off.
                late = place == size - 1 and attempt < 2 and shift + least > 0
                shift = (shift + least) * (1 - 4 * EPS) if late else shift / 4 if attempt < 2 else 0.0
            q, e, moved = np.maximum(new_q, 0), np.maximum(new_e, 0), moved + shift
    return scale * np.sqrt(np.sort(np.maximum(found, 0))[::-1])


class _Twisted:
    """B'B less a value, factored from both ends up to the twist."""

    def __init__(self, q: np.ndarray, ratio: np.ndarray, value: float, tiny: float):
        size = len(q)
        self.down, self.up = np.empty(size - 1), np.empty(size - 1)
        top, bottom = np.empty(size), np.empty(size)  # pivots
        s, p = np.empty(size), np.empty(size)

        def safe(x: float) -> float:
            return x if abs(x) > tiny else math.copysign(tiny, x)

        s[0] = -value
        for k in range(size - 1):
            top[k] = safe(s[k] + q[k])
            self.down[k] = q[k] * ratio[k] / top[k]
            s[k + 1] = self.down[k] * ratio[k] * s[k] - value
        p[-1] = q[-1] - value
        for k in range(size - 2, -1, -1):
            bottom[k + 1] = safe(q[k] * ratio[k] ** 2 + p[k + 1])
            part = q[k] / bottom[k + 1]
            self.up[k] = ratio[k] * part
            p[k] = p[k + 1] * part - value
        rest = s + p + value
        self.twist = int(np.argmin(np.abs(rest)))
        self.pivot = np.concatenate([top[:self.twist], [safe(rest[self.twist])], bottom[self.twist + 1:]])

    def _back(self, x: np.ndarray) -> np.ndarray:
        for k in range(self.twist - 1, -1, -1):
            x[k] -= self.down[k] * x[k + 1]
        for k in range(self.twist, len(x) - 1):
            x[k + 1] -= self.up[k] * x[k]
        return x / np.linalg.norm(x)

    def vector(self) -> np.ndarray:
        x = np.zeros(len(self.pivot))
        x[self.twist] = 1
        return self._back(x)

    def solve(self, y: np.ndarray) -> np.ndarray:
        y = y.copy()
        for k in range(self.twist):
            y[k + 1] -= self.down[k] * y[k]
        for k in range(len(y) - 1, self.twist, -1):
            y[k - 1] -= self.up[k - 1] * y[k]
        y /= self.pivot
        return self._back(y / np.abs(y).max())


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix, a column for each of the given largest values."""
    size, largest = len(diagonal), float(values[0])
    if size == 1:
        return np.ones((1, len(values)))
    # A zero on the diagonal would end the factorisations; this much is within rounding.
    diagonal = np.where(np.abs(diagonal) < EPS * largest, EPS * largest, diagonal) / largest
    above = above / largest
    rng, columns = np.random.default_rng(0), np.empty((size, len(values)))
    first = 0  # of the cluster
    for k, value in enumerate((values / largest) ** 2):
        if k and (values[k - 1] / largest) ** 2 - value > CLUSTER:
            first = k
        factors = _Twisted(diagonal ** 2, above / diagonal[:-1], value, EPS * max(value, EPS))
        x, near = factors.vector(), columns[:, first:k]
        for turn in range(6 if k > first else 0):
            before = np.linalg.norm(x)
            x = x - near @ (near.T @ x)
            if np.linalg.norm(x) < 0.01 * before:  # the same vector as one before it
                x = rng.standard_normal(size)
                x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
            if turn < 5:
                x = factors.solve(x)
        for _ in range(2):
            x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
        columns[:, k] = x
    return columns


def principal(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a triangle above rounding, largest first and at most ``components``, and
    their right singular vectors as columns."""
    diagonal, above, right = bidiagonalise(r)
    size, largest = len(r), max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    # The matrix falls apart where the superdiagonal is within rounding; equal values are then in
    # unlike parts, and their vectors orthogonal from the start.
    cuts = [0, *(np.flatnonzero(np.abs(above) <= size * EPS * largest) + 1).tolist(), size]
    parts = [(a, dqds(diagonal[a:b], above[a:b - 1])) for a, b in zip(cuts, cuts[1:])]
    least = size * EPS * max(values[0] for _, values in parts)
    ranked = sorted(((v, a) for a, values in parts for v in values if v > least), reverse=True)[:components]
    vectors = np.zeros((size, len(ranked)))
    for a, b in zip(cuts, cuts[1:]):
        places = [k for k, (_, start) in enumerate(ranked) if start == a]
        if places:
            values = np.array([ranked[k][0] for k in places])
            vectors[a:b, places] = twisted_vectors(diagonal[a:b], above[a:b - 1], values)
    for at, v in reversed(right):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    return np.array([v for v, _ in ranked]), vectors


# The scans.

def _usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & ~bad)


def integers(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors as rows of integers x."""
    lengths = pc.list_value_length(column)
    bounds = pc.min_max(lengths).as_py()
    if bounds["min"] != bounds["max"] or width not in (None, bounds["min"]):
        raise ValueError("vectors must all have the same length")
    if bounds["min"] > MAX_WIDTH:
        raise ValueError(f"vectors have more than {MAX_WIDTH} entries")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > 2 ** 52:
        raise OverflowError("an entry is too large to count as a 64-bit integer")
    return (scaled.astype(np.int64) + OFFSET).reshape(len(column), -1)


def _merged(df: DataFrame, task: Callable[[Iterator[pa.Array]], bytes | None], merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """One result over all partitions of a one-column table of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = task(batch.column(0) for batch in batches if batch.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([found], pa.binary())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.binary())})

    tasks = df.rdd.getNumPartitions()
    parts = df.mapInArrow(run, "v binary")
    while tasks > TREE_WIDTH:
        tasks = -(-tasks // TREE_WIDTH)
        parts = parts.repartition(tasks).mapInArrow(gather, "v binary")
    found = [bytes(row.v) for row in parts.collect()]
    return reduce(merge, found) if found else None


def _add(a: bytes, b: bytes) -> bytes:
    a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    if len(a) != len(b):
        raise ValueError("vectors must all have the same length")
    return (a + b).tobytes()


def _sums(columns: Iterator[pa.Array]) -> bytes | None:
    total = None
    for column in columns:
        rows = integers(column)
        part = np.append(len(rows), rows.sum(axis=0)).tobytes()
        total = part if total is None else _add(total, part)
    return total


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, square."""
    r = np.linalg.qr(rows, mode="r")
    return r if r.shape[0] == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - r.shape[0], r.shape[1]))])


def _as_square(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data)
    return flat.reshape(math.isqrt(len(flat)), -1)


@dataclass(frozen=True)
class Whitening:
    """``directions`` has a column per component; eigenvalues are those of the covariance of x."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """x - S / n, from exact integers."""
        return (self.n * rows - self.sums) / self.n

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ (self.directions / np.sqrt(self.eigenvalues))

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """Sum of (n x - S) ** 2 by row, exact."""
        apart = self.n * rows - self.sums
        if (apart.astype(np.float64) ** 2).sum(axis=1).max(initial=0) > 2.0 ** 62:
            exact = [sum(int(x) ** 2 for x in row) for row in apart]
            if max(exact) >= 2 ** 63:
                raise OverflowError("a deviation does not fit 64 bits")
            return np.array(exact, np.int64)
        return (apart * apart).sum(axis=1)


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitening | None:
    """Fit on all usable rows; None if there are none.

    Unusable are rows whose vector is null or empty or holds a null or non-finite entry. Vectors of
    unlike lengths are an error. Components are as many as asked for, fewer where the covariance has
    no more eigenvalues above rounding (few rows, constant or dependent entries, equal rows only).
    """
    vectors = spread_small(_usable(df, vector_col).select(F.col(f"`{vector_col}`").alias("v")))
    totals = _merged(vectors, _sums, _add)
    if totals is None:
        return None
    n, sums = int(np.frombuffer(totals, np.int64)[0]), np.frombuffer(totals, np.int64)[1:].copy()
    width = len(sums)

    def reduce_rows(columns: Iterator[pa.Array]) -> bytes | None:
        r = None
        for column in columns:
            rows = integers(column, width)
            for at in range(0, len(rows), BLOCK):
                block = (n * rows[at:at + BLOCK] - sums) / n
                r = _triangle(block if r is None else np.vstack([r, block]))
        return None if r is None else r.tobytes()

    r = _as_square(_merged(vectors, reduce_rows, lambda a, b: _triangle(np.vstack([_as_square(a), _as_square(b)])).tobytes()))
    values, directions = principal(r, components)
    return Whitening(n, sums, directions, values ** 2 / n, float((r ** 2).sum() / n))


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest entry of the whitened rows' covariance minus the identity.

    Blocks are centred on their own mean before multiplying; means and products of blocks are merged.
    """
    shared, k, width = df.sparkSession.sparkContext.broadcast(model), len(model.eigenvalues), len(model.sums)

    def both(a: bytes, b: bytes) -> bytes:
        a, b = np.frombuffer(a), np.frombuffer(b)
        n, apart = a[0] + b[0], b[1:k + 1] - a[1:k + 1]
        products = a[k + 1:] + b[k + 1:] + (np.outer(apart, apart) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], a[1:k + 1] + apart * (b[0] / n), products]).tobytes()

    def task(columns: Iterator[pa.Array]) -> bytes | None:
        total = None
        for column in columns:
            rows = shared.value.apply(integers(column, width))
            mean = rows.mean(axis=0)
            part = np.concatenate([[len(rows)], mean, ((rows - mean).T @ (rows - mean)).ravel()]).tobytes()
            total = part if total is None else both(total, part)
        return total

    found = np.frombuffer(_merged(_usable(df, vector_col).select(F.col(f"`{vector_col}`").alias("v")), task, both))
    return float(np.abs(found[k + 1:].reshape(k, k) / found[0] - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, model: Whitening | None, vector_col: str = "embedding", output: str = "whitened") -> DataFrame:
    """The table with a column of whitened coordinates; null where the vector is unusable or nothing was fitted."""
    output = fresh(output, df)
    if model is None:
        return df.withColumn(output, F.lit(None).cast("array<double>"))
    shared, width = df.sparkSession.sparkContext.broadcast(model), len(model.sums)

    @F.arrow_udf("array<double>")
    def coordinates(vectors: pa.Array) -> pa.Array:
        usable = vectors.drop_null()
        rows = shared.value.apply(integers(usable, width)) if len(usable) else np.zeros((0, 1))
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(np.where(there, rows.shape[1], 0)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel()), mask=pa.array(~there))

    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.withColumn(output, coordinates(F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, v)))


def whitened_components(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Unusable vectors give no row, as does a covariance of zero; an empty table gives an empty one. Null
    and repeated ids give rows of their own. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    source = _usable(df, vector_col).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(df, model, vector_col)
    shared, k, width = df.sparkSession.sparkContext.broadcast(model), len(model.eigenvalues), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = integers(part.column("v"), width)
                count = len(rows)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(count), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    "n": pa.array(np.full(count * k, fitted.n)),
                    "deviation": pa.array(np.repeat(fitted.deviations(rows), k)),
                    "whitened": pa.array(fitted.apply(rows).ravel()),
                    "explained": pa.array(np.tile(fitted.eigenvalues / fitted.trace, count)),
                    "identity_error": pa.array(np.full(count * k, error))})

    return source.mapInArrow(run, schema)
