"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a-z/A-Z folding means here: only ASCII letters change.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Texts of one Arrow batch are worked on in slices of about this many bytes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or ``name`` with underscores behind it, that no frame has as a column."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hashes(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes that only repeated rows have in common; nulls are told apart from empty texts."""
    parts = [F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def row_key(id_col: str, text_col: str) -> Column:
    """The two hashes of a row as one text."""
    return F.concat_ws(":", *map(F.hex, row_hashes(id_col, text_col)))


def binary(column: pa.Array) -> pa.Array:
    """A string column's UTF-8 bytes, without copying."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts add up to about ``most`` bytes; one row at least."""
    start = size = 0
    for row, length in enumerate(pc.binary_length(batch.column(text_col)).to_pylist()):
        if size and size + (length or 0) > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def split_by_size(df: DataFrame, size: Column, most: int, order: list[str]) -> list[DataFrame]:
    """Cut a stated query set into blocks whose ``size`` adds up to ``most``, for block-wise passes.

    Only one number per row of the query set is ranged over; a set below ``most`` is one block.
    """
    total = df.agg(F.sum(size)).head()[0] or 0
    count = -(-int(total) // most)
    if count <= 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(*order), F.lit(count)) == k) for k in range(count)]
