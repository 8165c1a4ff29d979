"""From a raw flow frame to the rows the classifiers can use."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F, types as T

from flowsentry.functions.columns import INF, col, is_finite
from flowsentry.functions.session import materialise

FLOATS = (T.DoubleType, T.FloatType)


class MissingFeatureError(ValueError):
    """The frame lacks columns of the feature contract."""


class EmptyFlowsError(ValueError):
    """No row of the input is usable."""


def unique_names(names: Sequence[str]) -> list[str]:
    """Keep the first of equal names and give later ones the suffix .1, .2, ..."""
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, copies = name, 0
        while candidate in taken:
            copies += 1
            candidate = f"{name}.{copies}"
        taken.add(candidate)
        result.append(candidate)
    return result


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([name.strip() for name in df.columns]))


def _float_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)}


def null_infinities(df: DataFrame, known_finite: Sequence[str] = ()) -> DataFrame:
    """Replace plus and minus infinity by null in every floating column."""
    floats = _float_columns(df) - set(known_finite)
    return df.select(
        *[F.when(~col(n).isin(INF, -INF), col(n)).alias(n) if n in floats else col(n)
          for n in df.columns]
    )


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Project onto the contract, in its order; names are compared exactly."""
    present = set(df.columns)
    missing = [f for f in features if f not in present]
    if missing:
        raise MissingFeatureError(f"missing columns: {missing}")
    return df.select(*[col(f) for f in features])


def usable_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose contract columns are all present and finite, with every original column.

    The filter stands on the source columns themselves, so its null checks reach the
    file scan; infinities left in the other columns become null.
    """
    trimmed = trim_headers(df)
    require_features(trimmed, features)
    floats = _float_columns(trimmed)
    checks = [is_finite(col(f)) if f in floats else col(f).isNotNull() for f in features]
    return null_infinities(trimmed.filter(reduce(and_, checks)), features)


def require_nonempty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyFlowsError("no usable rows")
    return df


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns holding a single value, found in one pass."""
    row = df.agg(
        *[e for i, c in enumerate(columns)
          for e in (F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"))]
    ).head()
    return [c for i, c in enumerate(columns) if row[f"lo{i}"] == row[f"hi{i}"]]


def repeated_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Map each column that repeats an earlier one to that earlier column.

    One pass sums a hash per column; only columns with equal sums are then compared
    row by row, so the work does not grow with the square of the column count.
    """
    sums = df.agg(
        *[F.sum(F.xxhash64(col(c)).cast("decimal(38,0)")).alias(f"h{i}")
          for i, c in enumerate(columns)]
    ).head()
    groups: dict = {}
    for i, c in enumerate(columns):
        groups.setdefault(sums[f"h{i}"], []).append(c)
    pairs = [(g[i], g[j]) for g in groups.values() for j in range(len(g)) for i in range(j)]
    if not pairs:
        return {}
    differing = df.agg(
        *[F.count_if(~col(a).eqNullSafe(col(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    ).head()
    repeats: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if differing[f"d{i}"] == 0 and a not in repeats:
            repeats.setdefault(b, a)
    return repeats


def clean_training(
    df: DataFrame, features: Sequence[str], label: str | None = None, key: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Distinct training rows, and the features left without constant or repeated columns.

    With ``key``, each distinct row comes with the smallest key of those it stands for. Equal rows
    are put together before the shuffle, so a row that is repeated very often weighs on no task.
    """
    kept = [*features, *([label] if label else [])]
    usable = usable_rows(df, features)
    if key:
        rows = usable.groupBy(*[col(c) for c in kept]).agg(F.min(col(key)).alias(key))
    else:
        rows = usable.select(*[col(c) for c in kept]).distinct()
    distinct = materialise(rows, "distinct")  # scanned up to four times
    constant = set(constant_columns(distinct, features))
    varying = [f for f in features if f not in constant]
    repeats = repeated_columns(distinct, varying) if varying else {}
    left = [f for f in varying if f not in repeats]
    chosen = [*([key] if key else []), *left, *([label] if label else [])]
    return distinct.select(*[col(c) for c in chosen]), left
