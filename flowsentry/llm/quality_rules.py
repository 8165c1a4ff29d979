"""Quality rules whose cutoffs are chosen on labelled documents at a controlled risk.

Besides fixed base rules, each measured share (symbols, repeated lines, repeated words, short or
long words) may reject documents above (or below) a cutoff. For every stratum, measure and
candidate cutoff, the holdout of good labelled documents gives k rejected of n. The exact
one-sided binomial (Clopper-Pearson) bound of the false-rejection rate is taken at a confidence
that the Bonferroni correction shares among all tests, and the strictest cutoff whose bound stays
below the rule's equal share of the allowed rate is used. A stratum with too few labels gets no cutoff and keeps its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise

from .common import binary, slices

MIN_WORDS = 50
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _measure(data: bytes) -> tuple[int, ...]:
    words = data.split()  # bytes.split cuts at the six ASCII white-space signs
    number = len(words)
    continuation = sum(len(w) for w in words)
    chars = continuation if data.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    repeated = len(lines) - len(set(lines))
    in_repeats = 0
    if number >= 3:
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, number)
        size = len(codes)
        pairs = ids[:-1] * size + ids[1:]
        _, pairs = np.unique(pairs, return_inverse=True)
        _, place, count = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        twice = count[place] > 1
        hit = np.zeros(number, bool)
        for shift in range(3):
            hit[shift:shift + number - 2] |= twice
        in_repeats = int(hit.sum())
    return number, chars, symbols, repeated, in_repeats, len(lines)


def measure_documents(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the counts of every whole text. A null text counts as empty."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "__text"):
                rows = [_measure(data) for data in binary(piece.column("__text")).to_pylist()]
                counts = np.array(rows, np.int64).reshape(-1, len(_COUNTS))
                columns = {c: piece.column(c) for c in keep}
                columns |= {c: pa.array(counts[:, k]) for k, c in enumerate(_COUNTS)}
                yield pa.RecordBatch.from_pydict(columns)

    source = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return source.mapInArrow(run, kinds + "".join(f", {c} long" for c in _COUNTS))


def base_failed() -> Column:
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > 50 * words)


@dataclass(frozen=True)
class Rule:
    """``value`` lies in 0..1 and speaks against a document the larger it is."""

    name: str
    value: Column


def rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / words
    return [
        Rule("symbols", F.least(F.lit(1.0), F.col("n_symbols") / words)),
        Rule("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        Rule("repeats", F.col("n_repeat_words") / words),
        Rule("short_words", F.greatest(F.lit(0.0), 1 - length / 8)),
        Rule("long_words", F.least(F.lit(1.0), length / 40)),
    ]


def chance_of_at_most(rejected: int, n: int, rate: float) -> float:
    """Chance of ``rejected`` or fewer of n cases at a rate: the incomplete beta function
    I(1 - rate; n - rejected, rejected + 1) by its continued fraction, of about sqrt(n) terms at most."""
    if rejected >= n or rate <= 0:
        return 1.0
    if rejected < 0 or rate >= 1:
        return 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        out = d
        for m in range(1, 100_000):
            for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + part * d) or 1e-300)
                c = (1 + part / c) or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    a, b, x = n - rejected, rejected + 1, 1 - rate
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-rate) + b * math.log(rate))
    # The fraction converges fast on one side of the mean; the other side is its complement.
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(x, a, b) / a)
    return max(0.0, 1 - front * fraction(rate, b, a) / b)


def upper_bound(rejected: int, n: int, risk: float) -> float:
    """Clopper-Pearson: the largest rate under which ``rejected`` or fewer of n has chance ``risk``."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chance_of_at_most(rejected, n, middle) > risk else (low, middle)
    return high


def within(rejected: int, n: int, rate: float, risk: float) -> bool:
    """Is the upper bound at most ``rate``? It is just when so few rejections have chance ``risk`` at most."""
    return 0 < n and rejected <= rate * n and chance_of_at_most(rejected, n, rate) <= risk


@dataclass(frozen=True)
class Settings:
    """``grid`` candidate cutoffs per rule; false rejections allowed to all rules together in a
    stratum, and the risk of exceeding that anywhere."""

    grid: int = 40
    allowed: float = 0.01
    risk: float = 0.05


def choose_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, settings: Settings = Settings(),
                   id_col: str = "doc_id") -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from good labelled documents that pass the base rules.

    The driver sees one row per stratum, rule and grid cell: strata come from a label-like column,
    checked to be 10,000 at most. Documents with contradicting labels, or a null one, are left out.
    """
    good = (
        labels.groupBy(F.col(id_col).alias("__id"))
        .agg(F.min("quality").alias("low"), F.count(F.when(F.col("quality").isNull(), 1)).alias("gaps"))
        .filter("low = 1 and gaps = 0").select("__id")
    )
    held = measured.filter(~base_failed()).join(good, measured[id_col] == good["__id"], "left_semi")
    cells = F.array(*(F.struct(F.lit(r.name).alias("rule"),
                               F.ceil(r.value * settings.grid).cast("int").alias("cell")) for r in rules()))
    counted = (
        held.select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.explode(cells).alias("c"))
        .groupBy("stratum", "c.rule", "c.cell").count()
    )
    rows = counted.limit(10_000 * (settings.grid + 1) * len(rules()) + 1).collect()
    strata = sorted({r["stratum"] for r in rows})
    if len(strata) > 10_000:
        raise ValueError(f"column {stratum} has more than 10,000 values; it is no stratum")
    tests, share = max(1, len(strata) * len(rules()) * settings.grid), settings.allowed / len(rules())
    by: dict[tuple[str, str], np.ndarray] = {}
    for r in rows:
        by.setdefault((r["stratum"], r["rule"]), np.zeros(settings.grid + 1, np.int64))[r["cell"]] += r["count"]
    chosen = {}
    for key, cell in by.items():
        n, beyond = int(cell.sum()), cell[::-1].cumsum()[::-1]
        # A cutoff at k / grid rejects what lies above it: cells k + 1 and more, fewer with every k.
        low, high = 0, settings.grid
        while low < high:
            middle = (low + high) // 2
            if within(int(beyond[middle + 1]), n, share, settings.risk / tests):
                high = middle
            else:
                low = middle + 1
        if low < settings.grid:
            chosen[key] = low / settings.grid
    return chosen


def apply_rules(measured: DataFrame, cutoffs: dict[tuple[str, str], float], stratum: str) -> DataFrame:
    """Adds base_failed and kept."""
    broken = F.lit(False)
    value_of = {r.name: r.value for r in rules()}
    by_rule: dict[str, dict[str, float]] = {}
    for (name, rule), cutoff in cutoffs.items():
        by_rule.setdefault(rule, {})[name] = cutoff
    for rule, found in sorted(by_rule.items()):
        pairs = [F.lit(x) for pair in sorted(found.items()) for x in pair]
        cutoff = F.element_at(F.create_map(*pairs), F.coalesce(F.col(stratum), F.lit("")))
        broken = broken | F.coalesce(value_of[rule] > cutoff, F.lit(False))
    failed = base_failed()
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~broken})


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id",
                    text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Measure, choose cutoffs, and judge every document.

    Returns doc_id, the counts, base_failed and kept, a row per input row. Null and empty texts have
    no words and fail the base rules. Rows of equal id are judged each by its own text and count each
    as a labelled case. Labels of unknown ids are not used; without labels only the base rules act.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                         F.col(text_col).alias("text"))
    measured = measure_documents(narrow, ["doc_id", "stratum"])
    wanted = labels.select(F.col(id_col).alias("doc_id"), "quality")
    measured = materialise(measured, "measured")  # small rows; the texts are read once
    cutoffs = choose_cutoffs(measured, wanted, "stratum", settings)
    return apply_rules(measured, cutoffs, "stratum").select("doc_id", *_COUNTS[:5], "base_failed", "kept")
