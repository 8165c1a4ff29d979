"""Arrow columns as numpy arrays, and vector sums over all tasks of a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array) -> np.ndarray:
    """A list<float> column as a 2-D array, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), dtype=np.float32)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


TREE_WIDTH = 32


def vector_batch(vector: np.ndarray) -> pa.RecordBatch:
    """One row holding a vector of doubles."""
    return pa.RecordBatch.from_pydict({"v": [np.ascontiguousarray(vector, np.float64).tobytes()]})


def add_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column("v").to_pylist():
            part = np.frombuffer(data)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield vector_batch(total)


def sum_over_tasks(df: DataFrame, task: Callable, tasks: int) -> np.ndarray:
    """Run ``task`` (batches in, one vector out) on every partition and add the vectors.

    Beyond TREE_WIDTH tasks an inner level of tasks adds them up first, so the driver
    receives about the square root of the number of partitions.
    """
    partial = df.mapInArrow(task, "v binary")
    if tasks > TREE_WIDTH:
        partial = partial.repartition(math.isqrt(tasks)).mapInArrow(add_vectors, "v binary")
    return sum(np.frombuffer(row.v) for row in partial.collect())
