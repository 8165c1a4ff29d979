"""Column expressions shared by batch, streaming and SQL-checked queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(name: str) -> Column:
    """A column by exact name; flow headers contain blanks, slashes and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_finite(column: Column) -> Column:
    """Not null, not NaN (which orders above infinity) and not infinite."""
    return (column > F.lit(-INF)) & (column < F.lit(INF))


def narrow_float32(column: Column) -> Column:
    return column.cast("float")


def one_hot(column: Column, level: str) -> Column:
    """1 where the column equals the level, else 0; an unseen level is 0 everywhere."""
    return F.when(column == F.lit(level), F.lit(1.0)).otherwise(F.lit(0.0))


def min_max(column: Column, low: float, high: float, clip: bool = False) -> Column:
    """(x - low) / (high - low); a constant column scales to 0. Not clipped by default."""
    if high == low:
        scaled = column.cast("double") * 0.0
    else:
        scaled = (column.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)) if clip else scaled


def dot(columns: Sequence[Column], weights: Sequence[float], intercept: float) -> Column:
    """sum(x * w) + b as plain arithmetic, so it stays inside whole-stage codegen."""
    terms = [c.cast("double") * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]
    return reduce(add, terms, F.lit(0.0)) + F.lit(float(intercept))


def linear_score(features: Column, weights: Sequence[float], intercept: float) -> Column:
    """Linear score over an array column; items are addressed one by one."""
    return dot([features[i] for i in range(len(weights))], weights, intercept)


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def apply_threshold(score: Column, threshold: float) -> Column:
    """Decision rule for scored models: attack from the threshold upwards."""
    return (score >= F.lit(float(threshold))).cast("int")


def decode_label(label: Column) -> Column:
    return F.when(label == 1, F.lit("Attack")).otherwise(F.lit("Normal"))


def percent(part: Column, whole: Column, digits: int, half_even: bool = True) -> Column:
    share = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.bround(share, digits) if half_even else F.round(share, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def hash_order(key: Column, seed: int, purpose: str = "") -> Column:
    """A reproducible pseudo-random order of rows: md5 of seed, purpose and row key."""
    prefix = f"{seed}-{purpose}-" if purpose else f"{seed}-"
    return F.md5(F.concat(F.lit(prefix), key.cast("string")))
