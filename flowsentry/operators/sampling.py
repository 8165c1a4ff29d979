"""Seeded splits and samples of exact size, without sorting the table.

Every sample keeps the rows whose md5 order is lowest within their class. The cut-off
hash of a class is found by counting hash prefixes, level by level; the driver sees at
most 4096 counts per class and level and, at the end, one small bucket. Applying the
cut-off is a plain filter, so splitting a table needs no shuffle of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowsentry.functions.columns import col, hash_order

DIGITS = 3
MD5_DIGITS = 32
BUCKET_ROWS = 2000
COLLECT_ROWS = 50_000  # that buckets may have together to be fetched as they are
MAX_CLASSES = 1000
BELOW_ALL, ABOVE_ALL = "", "g"
REPEATED = "equal row keys lie on both sides of a cut, so its size cannot be exact; keys must be unique"


def _is_bytes(df: DataFrame) -> bool:
    return isinstance(df.schema["h"].dataType, T.BinaryType)


def _digits(df: DataFrame, count: int) -> Column:
    """The first hex digits of the order, in lower case; of bytes no more are spelled out than needed."""
    text = F.lower(F.hex(F.substring("h", 1, (count + 1) // 2))) if _is_bytes(df) else F.col("h")
    return F.substring(text, 1, count)


def _prefix_counts(df: DataFrame, open_prefixes: set, level: int) -> dict:
    """Row counts by (class, prefix, next digits) under the given prefixes."""
    if level:
        df = df.filter(_in_prefixes(df, open_prefixes, level))
    counts = df.groupBy("c", _digits(df, (level + 1) * DIGITS).alias("d")).count()
    result: dict = {}
    for row in counts.collect():  # 4096 per class or open prefix
        at = level * DIGITS
        result.setdefault((row.c, row.d[:at]), {})[row.d[at:]] = row["count"]
    return result


def _first_counts(df: DataFrame) -> dict:
    """Row counts by (class, no prefix, first digits), for at most MAX_CLASSES classes."""
    counts = df.groupBy("c", _digits(df, DIGITS).alias("d")).count()
    by_class = counts.groupBy("c").agg(F.collect_list(F.struct("d", "count")).alias("counts"))  # 4096 per class
    classes = by_class.limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return {(row.c, ""): {item["d"]: item["count"] for item in row.counts} for row in classes}


def _in_prefixes(df: DataFrame, prefixes: set, level: int) -> Column:
    """Rows of the given (class, prefix) pairs; few rows pass the prefixes and are looked at for their class."""
    digits = _digits(df, level * DIGITS)
    pair = F.concat_ws(":", F.col("c").cast("string"), digits)
    return digits.isin(*sorted({p for _, p in prefixes})) & pair.isin(*[_class_text(c) + ":" + p for c, p in prefixes])


def _class_text(c) -> str:
    """A class value as Spark casts it to a string."""
    return str(c).lower() if isinstance(c, bool) else str(c)


def hash_cutoffs(
    df: DataFrame, order: Column, by: Column, ranks: Callable[[dict], dict]
) -> dict:
    """Per class, the hash standing at each wanted rank (1-based) of the class's order.

    ``ranks`` maps the class counts to a list of ranks per class. Rank 0 gives a cut-off
    below every row, a rank beyond the class one above every row. ``order`` is a hash as hex digits, or as bytes.
    """
    hashed = df.select(by.alias("c"), order.alias("h")).filter(F.col("c").isNotNull())
    counts = _first_counts(hashed)
    sizes = {c: sum(d.values()) for (c, _), d in counts.items()}
    wanted = ranks(sizes)
    result: dict = {c: [None] * len(w) for c, w in wanted.items()}
    pending = []
    for c, ws in wanted.items():
        for i, r in enumerate(ws):
            if r <= 0:
                result[c][i] = BELOW_ALL
            elif r >= sizes[c]:
                result[c][i] = ABOVE_ALL
            else:
                pending.append([c, i, "", r])
    level, final = 0, []
    while pending:
        deeper, found = [], []
        for c, i, prefix, rank in pending:
            for digits, size in sorted(counts[(c, prefix)].items()):
                if rank <= size:
                    item = [c, i, prefix + digits, rank]
                    if len(item[2]) >= MD5_DIGITS:
                        raise ValueError(REPEATED)
                    found.append((item, size))
                    break
                rank -= size
        level += 1
        few = sum(dict(((item[0], item[2]), size) for item, size in found).values()) <= COLLECT_ROWS
        for item, size in found:
            if few or size <= BUCKET_ROWS:
                final.append((item, level))
            else:
                deeper.append(item)
        pending = deeper
        if pending:
            counts = _prefix_counts(hashed, {(c, p) for c, _, p, _ in pending}, level)
    if final:
        by_level: dict = {}
        for (c, _, p, _), depth in final:
            by_level.setdefault(depth, set()).add((c, p))
        condition = reduce(or_, [_in_prefixes(hashed, ps, depth) for depth, ps in by_level.items()])
        whole = hashed.filter(condition).select("c", F.lower(F.hex("h")).alias("h") if _is_bytes(hashed) else "h")
        buckets: dict = {}
        for row in whole.collect():
            buckets.setdefault(row.c, []).append(row.h)
        for (c, i, prefix, rank), _ in final:
            members = sorted(h for h in buckets[c] if h.startswith(prefix))
            if members[rank - 1] == members[min(rank, len(members) - 1)] and rank < len(members):
                raise ValueError(REPEATED)
            result[c][i] = members[rank - 1]
    return result


def _below(order: Column, by: Column, cutoffs: dict, which: int = 0, as_bytes: bool = False) -> Column:
    """True up to the cut-off of the row's class; the hash is computed once per row."""
    def literal(cut: str) -> Column:
        if not as_bytes:
            return F.lit(cut)
        return F.lit(bytearray(b"\xff" * (MD5_DIGITS // 2 + 1) if cut == ABOVE_ALL else bytes.fromhex(cut)))

    cut = literal(BELOW_ALL)
    for c, cuts in cutoffs.items():
        cut = F.when(by == F.lit(c), literal(cuts[which])).otherwise(cut)
    return order <= cut


def _is_bytes_order(df: DataFrame, order: Column) -> bool:
    return _is_bytes(df.select(order.alias("h")))


def proportional_shares(sizes: dict, n: int) -> dict:
    """Split n over the classes by size: floors first, then the largest remainders."""
    total = sum(sizes.values())
    if n >= total:
        return dict(sizes)
    shares = {c: n * s // total for c, s in sizes.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(n * sizes[c] % total), str(c)))
    for c in by_remainder[: n - sum(shares.values())]:
        shares[c] += 1
    return shares


def split_shares(sizes: dict, fraction: float = 0.7) -> dict:
    """Training rows per class: the test part is rounded up as a whole, then the training
    rows are shared out over the classes by size."""
    total = sum(sizes.values())
    train = total - math.ceil((1 - Fraction(str(fraction))) * total)
    return proportional_shares(sizes, train)


def split_filter(
    df: DataFrame, key: str, label: str, fraction: float = 0.7, seed: int = 42
) -> Column:
    """True for the training rows of a stratified split of ``df``."""
    return split_filters(df, [hash_order(col(key), seed)], label, fraction)[0]


def split_filters(df: DataFrame, orders: list[Column], label: str, fraction: float = 0.7) -> list[Column]:
    """``split_filter`` for each of several columns that hold the same order, found by the first, which alone
    may be bytes instead of hex digits."""
    cutoffs = hash_cutoffs(
        df, orders[0], col(label), lambda n: {c: [s] for c, s in split_shares(n, fraction).items()}
    )
    return [_below(order, col(label), cutoffs, as_bytes=k == 0 and _is_bytes_order(df, order)) for k, order in enumerate(orders)]


def stratified_split(
    df: DataFrame, key: str, label: str, fraction: float = 0.7, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames that keep the class shares, of exact size (split_shares).

    Rows without a label belong to neither.
    """
    inside = split_filter(df, key, label, fraction, seed)
    return df.filter(inside), df.filter(~inside & col(label).isNotNull())


def balance_filter(df: DataFrame, key: str, label: str, seed: int = 42) -> Column:
    """True for the rows kept when every class is cut to the size of the smallest."""
    return balance_filters(df, [hash_order(col(key), seed, "balance")], label)[0]


def balance_filters(df: DataFrame, orders: list[Column], label: str) -> list[Column]:
    """``balance_filter`` for each of several columns that hold the same order, found by the first, which alone
    may be bytes instead of hex digits."""
    cutoffs = hash_cutoffs(df, orders[0], col(label), lambda n: {c: [min(n.values())] for c in n})
    return [_below(order, col(label), cutoffs, as_bytes=k == 0 and _is_bytes_order(df, order)) for k, order in enumerate(orders)]


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Cut every class down to the size of the smallest one."""
    return df.filter(balance_filter(df, key, label, seed))


def subsample(
    df: DataFrame, n: int, key: str, label: str | None = None, seed: int = 42
) -> DataFrame:
    """Exactly n rows (all rows if there are fewer), with class shares kept if labelled."""
    order = hash_order(col(key), seed, "tune")
    by = col(label) if label else F.lit(0)
    cutoffs = hash_cutoffs(
        df, order, by, lambda sizes: {c: [s] for c, s in proportional_shares(sizes, n).items()}
    )
    return df.filter(_below(order, by, cutoffs))


def assign_folds(
    df: DataFrame, key: str, label: str, folds: int = 3, seed: int = 42, output: str = "fold"
) -> DataFrame:
    """Number rows 0..folds-1 so that every class is spread evenly over the folds.

    Rows without a label get no fold.
    """
    order = hash_order(col(key), seed, "fold")
    cutoffs = hash_cutoffs(
        df, order, col(label),
        lambda n: {c: [s * (i + 1) // folds for i in range(folds - 1)] for c, s in n.items()},
    )
    fold = F.lit(folds - 1)
    for i in reversed(range(folds - 1)):
        fold = F.when(_below(order, col(label), cutoffs, i), F.lit(i)).otherwise(fold)
    return df.withColumn(output, F.when(col(label).isNotNull(), fold.cast("int")))
