"""Result documents of training runs: schema, writers, and the flat run table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.profiles import MODEL_ORDER, STUDY_SEEDS, normalise_model_name

METRICS = (
    "accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision",
    "false_positive_rate",
)
TIMINGS = ("training_seconds", "prediction_seconds")
RUN_COLUMNS = ("run", "seed", "dataset", "model", *METRICS, *TIMINGS, "testing_rows")

RESULT_DDL = """
dataset string, model string, training_rows bigint, testing_rows bigint, input_features int,
architecture struct<hidden_layers: array<int>, activation: string, optimizer: string,
  batch_size: int, learning_rate_init: double, maximum_epochs: int, early_stopping: boolean,
  validation_fraction: double, n_iter_no_change: int, tasks: int>,
cross_validation struct<folds: int, scoring: string, tuning_rows: int,
  candidate_C_values: array<double>, candidate_alpha_values: array<double>,
  mean_f1_scores: map<string, double>, selected_C: double, selected_alpha: double,
  candidate_count: int,
  candidate_scores: array<struct<parameters: struct<max_depth: int, max_features: string,
    min_samples_leaf: int, min_samples_split: int, n_estimators: int, n_neighbors: int,
    weights: string>, mean_f1_score: double>>,
  selected_parameters: struct<n_estimators: int, max_depth: int, min_samples_split: int,
    min_samples_leaf: int, max_features: string>,
  selected_neighbors: int, selected_weights: string, tuning_seconds: double>,
training_history struct<epochs_completed: int, best_validation_score: double>,
metrics struct<accuracy: double, precision: double, recall: double, f1_score: double,
  roc_auc: double, average_precision: double, false_positive_rate: double>,
decision_threshold double, decision_rule string,
confusion_matrix array<array<bigint>>,
feature_importances array<struct<feature: string, importance: double>>,
training_seconds double, prediction_seconds double
"""
RESULT_FIELDS = (
    "dataset", "model", "training_rows", "testing_rows", "input_features", "architecture",
    "cross_validation", "training_history", "metrics", "decision_threshold", "decision_rule",
    "confusion_matrix", "feature_importances", "training_seconds", "prediction_seconds",
)


def seed_of(run):
    """The seed of run_1, run_2, ... in the repeated study."""
    number = F.regexp_extract(run, r"(\d+)$", 1).cast("int")
    return F.get(F.array(*[F.lit(s) for s in STUDY_SEEDS]), number - 1)


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result documents as JSON, in folders <run>/<model>/<dataset>_results.

    The default replaces the documents of the same run, model and dataset and leaves the others.
    """
    folders = results.withColumns({
        "run_dir": F.col("run"), "model_dir": F.col("model"),
        "document": F.concat("dataset", F.lit("_results"))})
    folders.write.partitionBy("run_dir", "model_dir", "document").option(
        "partitionOverwriteMode", "dynamic").json(path, mode=mode)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Every result document under a folder tree, with the run taken from its path.

    Documents are told by "_results" in their path, so they may come from ``write_results`` or be
    single files <run>/.../<dataset>_results.json; other JSON files beside them are left out.
    """
    reader = spark.read.schema(RESULT_DDL).option("multiLine", True)
    found = reader.json(path, recursiveFileLookup=True, pathGlobFilter=pattern)
    file = F.col("_metadata.file_path")
    run = F.regexp_extract(file, r"run(?:_dir)?[=_](?:run_)?(\d+)", 1)
    return found.withColumn("run", F.concat(F.lit("run_"), run)).filter(file.rlike(r"_results(\.json$|/)"))


def run_table(documents: DataFrame) -> DataFrame:
    """One flat row of 14 columns per document, with short model names."""
    run = F.col("run")
    return documents.select(
        run, seed_of(run).alias("seed"), "dataset", normalise_model_name().alias("model"),
        *[F.col(f"metrics.{m}").alias(m) for m in METRICS], *TIMINGS, "testing_rows",
    )


def read_results(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """The run table of a whole study, over all runs, models and datasets."""
    return run_table(read_documents(spark, root, pattern))


def run_order(table: DataFrame) -> DataFrame:
    """Run-table order: run, then model and dataset."""
    position = F.array_position(
        F.array(*[F.lit(m) for m in (MODEL_ORDER[1], MODEL_ORDER[0], *MODEL_ORDER[2:])]), F.col("model"))
    number = F.regexp_extract("run", r"(\d+)$", 1).cast("int")  # run_10 comes after run_2
    return table.orderBy(number, "run", position, "dataset")


def summarise_results(documents: DataFrame) -> DataFrame:
    """Per run and model, a map from dataset to its result document."""
    fields = [f for f in RESULT_FIELDS if f in documents.columns]
    entry = F.struct(F.col("dataset").alias("key"), F.struct(*fields).alias("value"))
    # One entry per dataset.
    return documents.groupBy("run", "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry), _by_key)).alias("datasets"))


def _by_key(a, b):
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def write_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object {dataset: document} per line, in folders by run and model."""
    lines = summaries.select("run", "model", F.to_json("datasets").alias("value"))
    lines.write.mode(mode).partitionBy("run", "model").text(path)


def write_tables(runs: DataFrame, statistics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The run table and the statistics table as CSV with headers."""
    run_order(runs).coalesce(1).write.csv(f"{path}/per_run_metrics", header=True, mode=mode)
    statistics.coalesce(1).write.csv(f"{path}/mean_std_metrics", header=True, mode=mode)
