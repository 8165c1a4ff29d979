"""The five classifiers behind one interface: ``attach`` adds a score and a 0/1 label.

Every model reads the array column ``features``. Linear models score as plain
expressions inside codegen, the forest as flat arrays over whole batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsentry.functions.columns import apply_threshold, linear_score, logistic
from flowsentry.functions.session import scratch_path, write_json
from flowsentry.operators.forest import ForestModel, from_library, grow_forest
from flowsentry.operators.newton import MAX_SCANS, Packed, Problem, solve
from flowsentry.operators.perceptron import fit_weights

# Penalty grid of the linear models.
C_VALUES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)

# Candidate settings of the forest.
FOREST_CANDIDATES = (
    {"n_estimators": 150, "max_depth": 20, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": 20, "min_samples_split": 5, "min_samples_leaf": 1, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt"},
    {"n_estimators": 250, "max_depth": None, "min_samples_split": 5, "min_samples_leaf": 1, "max_features": "sqrt"},
    {"n_estimators": 200, "max_depth": 30, "min_samples_split": 2, "min_samples_leaf": 2, "max_features": "0.7"},
    {"n_estimators": 250, "max_depth": 30, "min_samples_split": 5, "min_samples_leaf": 2, "max_features": "0.7"},
)
MAX_DEPTH = 30  # the deepest tree that Spark ML grows
VECTOR = "_vector"


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn(VECTOR, array_to_vector(F.col(features)))


@dataclass
class LinearModel:
    """Logistic regression (probability score) or linear SVM (margin score)."""

    weights: list[float]
    intercept: float
    probability: bool
    threshold: float
    converged: bool = True
    scans: int | None = None  # of the table, where the solver counts them

    def attach(self, df: DataFrame, score: str, label: str) -> DataFrame:
        z = linear_score(F.col("features"), self.weights, self.intercept)
        value = logistic(z) if self.probability else z
        return df.withColumn(score, value).withColumn(
            label, apply_threshold(F.col(score), self.threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, path + "/kind", {"kind": "linear", **self.__dict__})


def score_column(probability: bool = True, column: str | None = None) -> Column:
    """The attack score in a Spark ML result: the probability, or the raw margin."""
    name = column or ("probability" if probability else "rawPrediction")
    return vector_to_array(F.col(name))[1]


@dataclass
class VectorModel:
    """A Spark ML classifier with probabilities: the sigmoid perceptron, or a forest stored as such."""

    model: RandomForestClassificationModel | MultilayerPerceptronClassificationModel
    kind: str
    threshold: float = 0.5

    def attach(self, df: DataFrame, score: str, label: str) -> DataFrame:
        model = self.model.copy()
        model.setFeaturesCol(VECTOR).setRawPredictionCol("").setPredictionCol("")
        model.setProbabilityCol("_probability")
        scored = model.transform(with_vector(df)).withColumn(
            score, score_column(column="_probability"))
        return scored.withColumn(label, apply_threshold(F.col(score), self.threshold)).drop(
            VECTOR, "_probability")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(path + "/model")
        write_json(spark, path + "/kind", {"kind": self.kind, "threshold": self.threshold})


class _Plain:
    """Fits a model without its training summary, by storing and loading it.

    The summary refers to the session, which cannot be sent to the executors with the model once a
    DataFrame has been observed in it.
    """

    def _fit(self, dataset: DataFrame):
        spark = dataset.sparkSession
        model, path = super()._fit(dataset), scratch_path(spark, "library-model")
        model.save(path)
        return type(model).read().session(spark).load(path)


class PlainLogisticRegression(_Plain, LogisticRegression):
    pass


class PlainLinearSVC(_Plain, LinearSVC):
    pass


class PlainForest(_Plain, RandomForestClassifier):
    pass


def logistic_estimator(c: float, rows: int, max_iter: int = 1000) -> LogisticRegression:
    """Inverse penalty C: half the squared weights against C times the summed loss."""
    return PlainLogisticRegression(
        featuresCol=VECTOR, labelCol="label", regParam=1.0 / (c * rows), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-6,
    )


def svm_estimator(c: float, rows: int, max_iter: int = 200) -> LinearSVC:
    """Hinge loss with the same penalty convention; decision at margin 0."""
    return PlainLinearSVC(
        featuresCol=VECTOR, labelCol="label", regParam=1.0 / (c * rows), threshold=0.0,
        standardization=False, maxIter=max_iter, tol=1e-5,
    )


def forest_estimator(
    n_estimators: int = 150, max_depth: int | None = 20, min_samples_split: int = 2,
    min_samples_leaf: int = 1, max_features: str = "sqrt", seed: int = 42,
) -> RandomForestClassifier:
    """Spark ML has no minimum split size beyond two leaves of ``min_samples_leaf`` rows, and grows
    trees of MAX_DEPTH at most; ``applied_parameters`` tells what comes of a request."""
    del min_samples_split
    if max_depth is not None and max_depth > MAX_DEPTH:
        raise ValueError(f"trees grow to a depth of {MAX_DEPTH} at most")
    return PlainForest(
        featuresCol=VECTOR, labelCol="label", numTrees=n_estimators,
        maxDepth=MAX_DEPTH if max_depth is None else max_depth,
        minInstancesPerNode=min_samples_leaf, featureSubsetStrategy=max_features, seed=seed,
        maxMemoryInMB=1024, cacheNodeIds=True,
    )


def applied_parameters(model: str, parameters: dict, solver: str = "histogram") -> dict:
    """The parameters that a fit really used, as result documents record them."""
    if model != "Random Forest" or solver != "library":
        return dict(parameters)
    depth = parameters.get("max_depth")
    return parameters | {
        "max_depth": MAX_DEPTH if depth is None else depth,
        "min_samples_split": max(2, 2 * parameters.get("min_samples_leaf", 1))}


def training_frame(train: DataFrame) -> DataFrame:
    return with_vector(train.select(F.col("label").cast("double").alias("label"), "features"))


def newton_models(
    table: DataFrame, problems: list[Problem], kind: str, max_scans: int = MAX_SCANS, packed: Packed | None = None,
) -> list[LinearModel]:
    """Models of several penalties and folds, fitted together over shared scans."""
    probability = kind == "logistic"
    found = solve(table, problems, kind, max_scans, packed)
    return [
        LinearModel([float(v) for v in w[:-1]], float(w[-1]), probability, 0.5 if probability else 0.0,
                    bool(ok), found.scans)
        for w, ok in zip(found.weights, found.converged)
    ]


def _all_rows(train: DataFrame) -> DataFrame:
    return train.select("features", F.col("label").cast("double").alias("label"), F.lit(0).alias("fold"))


def fit_logistic(
    train: DataFrame, c: float = 1.0, solver: str = "newton", max_iter: int | None = None, packed: Packed | None = None,
) -> LinearModel:
    """``newton`` scans the data about ten times; ``lbfgs`` suits very wide features.

    ``max_iter`` bounds the scans or iterations; the model says whether it converged. ``packed`` are the rows as
    ``newton.pack`` gives them, where they are there already.
    """
    if solver == "newton":
        return newton_models(_all_rows(train), [Problem(c)], "logistic", max_iter or MAX_SCANS, packed)[0]
    model = logistic_estimator(c, train.count(), max_iter or 1000).fit(training_frame(train))
    return LinearModel([float(w) for w in model.coefficients], float(model.intercept), True, 0.5)


def fit_linear_svm(
    train: DataFrame, c: float = 1.0, solver: str = "newton", max_iter: int | None = None, packed: Packed | None = None,
) -> LinearModel:
    """Squared hinge loss with ``newton``, plain hinge loss with ``owlqn``; see fit_logistic."""
    if solver == "newton":
        return newton_models(_all_rows(train), [Problem(c)], "squared_hinge", max_iter or MAX_SCANS, packed)[0]
    model = svm_estimator(c, train.count(), max_iter or 200).fit(training_frame(train))
    return LinearModel([float(w) for w in model.coefficients], float(model.intercept), False, 0.0)


def fit_forest(train: DataFrame, seed: int = 42, solver: str = "histogram", key: str | None = None, **parameters) -> ForestModel:
    """``histogram`` applies all parameters as they are; ``library`` is Spark ML's forest."""
    if solver == "histogram":
        return grow_forest(train, seed, key=key, **parameters)
    return from_library(train.sparkSession, forest_estimator(seed=seed, **parameters).fit(training_frame(train)))


def fit_mlp(
    train: DataFrame, hidden: tuple[int, ...] = (128, 64), max_iter: int = 100, seed: int = 42, solver: str = "scans",
) -> VectorModel:
    """Spark ML's multilayer perceptron: sigmoid units, L-BFGS.

    With ``scans`` the library gives the starting weights and the model, and the weights are trained over packed
    rows (see perceptron); ``library`` trains with the library itself.
    """
    first = train.select("features").head()
    layers = [len(first.features), *hidden, 2]

    def estimator(iterations: int, **start) -> MultilayerPerceptronClassifier:
        return MultilayerPerceptronClassifier(
            featuresCol=VECTOR, labelCol="label", layers=layers, maxIter=iterations, seed=seed, **start)

    if solver == "library":
        return VectorModel(estimator(max_iter).fit(training_frame(train)), "perceptron")
    # Without iterations the library takes its weights as they are, whatever the row.
    row = training_frame(train.sparkSession.createDataFrame([(0, first.features)], train.select(
        F.lit(0).alias("label"), "features").schema))
    start = estimator(0).fit(row).weights.toArray()
    missing = F.raise_error(F.lit("a label is missing")).cast("double")
    known = train.select("features", F.coalesce(F.col("label").cast("double"), missing).alias("label"))
    weights = fit_weights(_all_rows(known), layers, start, max_iter)
    return VectorModel(estimator(0, initialWeights=Vectors.dense(weights)).fit(row), "perceptron")


def feature_importances(spark: SparkSession, model: ForestModel | VectorModel, names: list[str]) -> DataFrame:
    """(feature, importance) rows, most important first."""
    values = model.importances if isinstance(model, ForestModel) else model.model.featureImportances.toArray()
    rows = list(zip(names, map(float, values), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")


@contextmanager
def timed(record: dict, name: str):
    """Store the wall-clock seconds of the enclosed action under ``name``."""
    start = time.perf_counter()
    yield
    record[name] = time.perf_counter() - start


def run_timed(action: Callable) -> tuple[object, float]:
    record: dict = {}
    with timed(record, "s"):
        result = action()
    return result, record["s"]
