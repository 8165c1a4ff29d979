"""Encoding, scaling and selection as plan-time column expressions.

A fitted preprocessor knows the levels, minima, maxima and the selected names, so its
transform is one projection over exactly the selected columns: nothing else is encoded
or scaled, and the columns not needed are pruned from the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from flowsentry.functions.columns import col, min_max, narrow_float32, one_hot
from flowsentry.operators.cleaning import usable_rows
from flowsentry.profiles import FlowProfile

MAX_LEVELS = 10_000
TOP_FEATURES = 20


@dataclass(frozen=True)
class FlowEncoder:
    """One-hot encodes the categoricals, in contract order, and passes numerics through."""

    features: tuple[str, ...]
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, profile: FlowProfile, max_levels: int = MAX_LEVELS) -> FlowEncoder:
        found: dict[str, list[str]] = {c: [] for c in profile.categoricals}
        if profile.categoricals:
            pairs = F.explode(F.array(
                *[F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in profile.categoricals]
            ))
            rows = (
                df.select(pairs.alias("e")).select("e.c", "e.v").distinct()
                .limit(max_levels + 1).collect()
            )
            if len(rows) > max_levels:
                raise ValueError(f"more than {max_levels} categorical levels")
            for row in rows:
                if row.v is not None:
                    found[row.c].append(row.v)
        return cls(profile.features, {c: tuple(sorted(v)) for c, v in found.items()})

    @property
    def names(self) -> list[str]:
        """Names of the encoded columns, ``<column>_<level>`` for one-hot ones."""
        return [name for name, _ in self._encoded()]

    def _encoded(self) -> list[tuple[str, Column]]:
        result = []
        for feature in self.features:
            if feature in self.levels:
                result += [(f"{feature}_{v}", one_hot(col(feature), v)) for v in self.levels[feature]]
            else:
                result.append((feature, col(feature)))
        return result

    def expressions(self) -> dict[str, Column]:
        """Every encoded column, narrowed to float32."""
        return {name: narrow_float32(c) for name, c in self._encoded()}

    def unseen_counts(self, df: DataFrame) -> DataFrame:
        """Per categorical, how many rows hold a level that was not in training."""
        counts = df.agg(
            *[F.count_if(~col(c).isin(*v)).alias(f"u{i}")
              for i, (c, v) in enumerate(self.levels.items())]
        )
        pairs = F.explode(F.array(
            *[F.struct(F.lit(c).alias("feature"), F.col(f"u{i}").alias("unseen_rows"))
              for i, c in enumerate(self.levels)]
        ))
        return counts.select(pairs.alias("e")).select("e.feature", "e.unseen_rows")


@dataclass(frozen=True)
class FlowScaler:
    """Min-max scaling over the encoded columns, fitted in one aggregate."""

    lows: dict[str, float]
    highs: dict[str, float]
    clip: bool = False

    @classmethod
    def fit(cls, df: DataFrame, encoder: FlowEncoder, clip: bool = False) -> FlowScaler:
        encoded = encoder.expressions()
        row = df.agg(
            *[e for i, c in enumerate(encoded.values())
              for e in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]
        ).head()
        names = list(encoded)
        if names and row["lo0"] is None:
            raise ValueError("cannot fit a scaler on an empty frame")
        return cls(
            {n: float(row[f"lo{i}"]) for i, n in enumerate(names)},
            {n: float(row[f"hi{i}"]) for i, n in enumerate(names)},
            clip,
        )

    def scale(self, name: str, column: Column) -> Column:
        return min_max(column, self.lows[name], self.highs[name], self.clip)


def scaled_columns(encoder: FlowEncoder, scaler: FlowScaler) -> dict[str, Column]:
    return {n: scaler.scale(n, c) for n, c in encoder.expressions().items()}


def anova_f_scores(df: DataFrame, columns: dict[str, Column], label: str) -> DataFrame:
    """ANOVA F of each column against the label, as rows (feature, f_score).

    One grouped aggregate yields count, mean and variance per class; everything after
    works on one row per class. Perfect separation gives infinity, no spread at all 0.
    """
    grouped = df.groupBy(col(label).alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        *[e for i, c in enumerate(columns.values())
          for e in (F.avg(c.cast("double")).alias(f"m{i}"),
                    F.var_samp(c.cast("double")).alias(f"v{i}"))],
    )
    stats = grouped.select("n", F.posexplode(F.array(
        *[F.struct(F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
          for i in range(len(columns))]
    )).alias("i", "s")).select("i", "n", "s.m", "s.v")
    feature = Window.partitionBy("i")  # one row per class
    mean = F.sum(F.col("n") * F.col("m")).over(feature) / F.sum("n").over(feature)
    scores = stats.withColumn("gm", mean).groupBy("i").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("between"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"),
        (F.count(F.lit(1)) - 1).alias("df1"),
        (F.sum("n") - F.count(F.lit(1))).alias("df2"),
    )
    names = F.array(*[F.lit(n) for n in columns])
    f_score = F.when(F.col("between") == 0, F.lit(0.0)).when(
        F.col("within") == 0, F.lit(float("inf"))
    ).otherwise((F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2")))
    return scores.select(names[F.col("i")].alias("feature"), f_score.alias("f_score"))


def mutual_information_scores(
    df: DataFrame, columns: dict[str, Column], label: str, bins: int = 16
) -> DataFrame:
    """Mutual information (nats) of each binned, scaled column with the label.

    Columns are scaled to 0..1 and cut into equal bins. The count table is keyed by
    (feature, bin, label), so the map side combines rows before any shuffle.
    """
    binned = F.array(*[
        F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(c * bins))).cast("int")
        for c in columns.values()
    ])
    cells = (
        df.select(col(label).alias("y"), F.posexplode(binned).alias("i", "b"))
        .groupBy("i", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    by_bin = cells.groupBy("i", "b").agg(F.sum("n").alias("nb"))
    by_label = cells.groupBy("i", "y").agg(F.sum("n").alias("ny"))
    totals = cells.groupBy("i").agg(F.sum("n").alias("nt"))
    joint = cells.join(by_bin, ["i", "b"]).join(by_label, ["i", "y"]).join(totals, "i")
    term = (F.col("n") / F.col("nt")) * F.log(
        F.col("n").cast("double") * F.col("nt") / (F.col("nb").cast("double") * F.col("ny"))
    )
    names = F.array(*[F.lit(n) for n in columns])
    return (
        joint.groupBy("i").agg(F.sum(term).alias("mi"))
        .select(names[F.col("i")].alias("feature"), F.greatest(F.lit(0.0), "mi").alias("mi_score"))
    )


def forest_scores(
    df: DataFrame, columns: dict[str, Column], label: str, seed: int = 42, trees: int = 50
) -> DataFrame:
    """Impurity importance of each column in a small random forest."""
    data = df.select(
        col(label).cast("double").alias("label"),
        array_to_vector(F.array(*columns.values())).alias("v"),
    )
    model = RandomForestClassifier(
        featuresCol="v", labelCol="label", numTrees=trees, maxDepth=10, seed=seed
    ).fit(data)
    rows = list(zip(columns, [float(x) for x in model.featureImportances.toArray()], strict=True))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_features(scores: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The k best (feature, score) rows, ties by name."""
    score = scores.columns[1]
    return scores.orderBy(F.col(score).desc(), "feature").limit(k)


@dataclass(frozen=True)
class FlowSelector:
    """The chosen positions within the encoded matrix, kept in matrix order."""

    indices: tuple[int, ...]

    @classmethod
    def fit(
        cls, df: DataFrame, encoder: FlowEncoder, scaler: FlowScaler, label: str,
        k: int = TOP_FEATURES, method: str = "anova", seed: int = 42,
    ) -> FlowSelector:
        columns = scaled_columns(encoder, scaler)
        if method == "anova":
            scores = anova_f_scores(df, columns, label)
        elif method == "mutual_information":
            scores = mutual_information_scores(df, columns, label)
        elif method == "forest":
            scores = forest_scores(df, columns, label, seed)
        else:
            raise ValueError(f"unknown selection method {method!r}")
        chosen = {row.feature for row in top_features(scores, k).collect()}
        return cls(tuple(i for i, n in enumerate(columns) if n in chosen))


@dataclass(frozen=True)
class FlowPreprocessor:
    """Fitted encoder, scaler and selector for one profile."""

    encoder: FlowEncoder
    scaler: FlowScaler
    selector: FlowSelector

    @classmethod
    def fit(
        cls, train: DataFrame, profile: FlowProfile, label: str = "label",
        k: int = TOP_FEATURES, method: str = "anova", seed: int = 42,
    ) -> FlowPreprocessor:
        """Fit on usable training rows that carry a 0/1 label."""
        encoder = FlowEncoder.fit(train, profile)
        scaler = FlowScaler.fit(train, encoder)
        return cls(encoder, scaler, FlowSelector.fit(train, encoder, scaler, label, k, method, seed))

    @property
    def selected(self) -> list[str]:
        names = self.encoder.names
        return [names[i] for i in self.selector.indices]

    def feature_array(self) -> Column:
        """The selected, scaled features of a row as array<float>."""
        encoded = self.encoder.expressions()
        return F.array(*[narrow_float32(self.scaler.scale(n, encoded[n])) for n in self.selected])

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Usable rows with all their columns, plus the feature array."""
        return usable_rows(df, self.encoder.features).withColumn(output, self.feature_array())

    def to_json(self) -> str:
        return json.dumps({
            "features": list(self.encoder.features),
            "levels": {c: list(v) for c, v in self.encoder.levels.items()},
            "lows": self.scaler.lows, "highs": self.scaler.highs, "clip": self.scaler.clip,
            "selected_indices": list(self.selector.indices),
        })

    @classmethod
    def from_json(cls, text: str) -> FlowPreprocessor:
        d = json.loads(text)
        return cls(
            FlowEncoder(tuple(d["features"]), {c: tuple(v) for c, v in d["levels"].items()}),
            FlowScaler(d["lows"], d["highs"], d["clip"]),
            FlowSelector(tuple(d["selected_indices"])),
        )
