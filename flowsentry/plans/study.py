"""Training and evaluating the classifiers over datasets and seeds."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.functions.columns import col, hash_order
from flowsentry.functions.session import materialise, release
from flowsentry.operators.classifiers import feature_importances, run_timed
from flowsentry.operators.cleaning import clean_training, usable_rows
from flowsentry.operators.features import TOP_FEATURES, FlowPreprocessor
from flowsentry.operators.forest import ForestModel
from flowsentry.operators.knn import KnnModel
from flowsentry.operators.metrics import evaluate
from flowsentry.operators.mlp import ARCHITECTURE, NetworkModel
from flowsentry.operators.sampling import balance_filter, balance_filters, split_filters
from flowsentry.operators.tuning import packed_folds, shares_scans, tune_and_fit
from flowsentry.profiles import DOCUMENT_NAME_OF, MODEL_ORDER, STUDY_SEEDS, FlowProfile, binarise_label
from flowsentry.sources.results import METRICS, RESULT_DDL, TIMINGS, run_table
from flowsentry.sources.store import Detector


def prepare(
    df: DataFrame, profile: FlowProfile, key: str, seed: int = 42, fraction: float = 0.7,
    k: int = TOP_FEATURES, method: str = "anova", clean: bool = False,
) -> tuple[FlowPreprocessor, DataFrame, DataFrame]:
    """Clean, split, balance the training part, fit the preprocessing and write both parts.

    Everything is fitted on training rows only; the test part keeps its natural shares.
    Rows without a label are left out.
    The source is read three times: for the hashed keys the sampling works on, for the balanced
    training rows, and for the test features.

    With ``clean``, equal training rows count once (as the one with the smallest key), and columns that
    are constant in them or repeat another one are left out, before the classes are balanced.
    """
    labelled = binarise_label(usable_rows(df, profile.features), profile).filter(F.col("label").isNotNull())
    cores = df.sparkSession.sparkContext.defaultParallelism
    split, balance = hash_order(col(key), seed), hash_order(col(key), seed, "balance")
    # Both orders are hashed once, as bytes; the sampling reads them from there.
    keys = materialise(labelled.select(F.unhex(split).alias("split"), F.unhex(balance).alias("balance"), "label"), "keys", spread=True)
    if labelled.rdd.getNumPartitions() < cores:  # a small source: use every core from here on
        labelled = labelled.repartition(cores)
    key_in_train, in_train = split_filters(keys, [F.col("split"), split], "label", fraction)
    contract = [f for f in profile.features if f not in (key, "label")]
    if clean:
        training, left = clean_training(labelled.filter(in_train), contract, "label", key)
        profile = replace(profile, features=tuple(left), categoricals=tuple(c for c in profile.categoricals if c in left))
        in_balance = balance_filter(training, key, "label", seed)
        rows = materialise(training.filter(in_balance), "train-rows", spread=True)
    else:
        _, in_balance = balance_filters(keys.filter(key_in_train), [F.col("balance"), balance], "label")
        rows = materialise(labelled.filter(in_balance & in_train).select(
            col(key), "label", *[col(f) for f in contract]), "train-rows", spread=True)
    release(keys)
    preprocessor = FlowPreprocessor.fit(rows, profile, "label", k, method, seed)
    features = preprocessor.feature_array().alias("features")
    test = labelled.filter(~in_train)
    train = materialise(rows.select(col(key), "label", features), "train")
    release(rows)
    return preprocessor, train, materialise(test.select(col(key), "label", features), "test", spread=True)


def result_document(
    spark: SparkSession, profile: FlowProfile, name: str, model, tuning: dict,
    selected: Sequence[str], training_rows: int, evaluation: dict, prediction_seconds: float,
) -> DataFrame:
    """One row in the result schema; fields that do not apply to the model are null."""
    scores, chosen = tuning["candidates"], tuning["selected"]
    cv = {
        "folds": tuning["folds"], "scoring": tuning["scoring"],
        "tuning_rows": tuning["tuning_rows"], "tuning_seconds": tuning["tuning_seconds"],
    }
    parsed = [(json.loads(s["parameters"]), s["mean_f1_score"]) for s in scores]
    if "C" in chosen:
        cv |= {"candidate_C_values": [p["C"] for p, _ in parsed], "selected_C": chosen["C"],
               "mean_f1_scores": {str(p["C"]): f for p, f in parsed}}
    elif "alpha" in chosen:
        cv |= {"candidate_alpha_values": [p["alpha"] for p, _ in parsed],
               "selected_alpha": chosen["alpha"],
               "mean_f1_scores": {str(p["alpha"]): f for p, f in parsed}}
    else:
        cv |= {"candidate_count": len(parsed),
               "candidate_scores": [{"parameters": p, "mean_f1_score": f} for p, f in parsed]}
        if "n_neighbors" in chosen:
            cv |= {"selected_neighbors": chosen["n_neighbors"], "selected_weights": chosen["weights"]}
        else:
            cv["selected_parameters"] = chosen
    document = {
        "dataset": profile.artifact, "model": DOCUMENT_NAME_OF.get(name, name), "training_rows": training_rows,
        "testing_rows": evaluation["testing_rows"], "input_features": len(selected),
        "cross_validation": cv, "metrics": {m: evaluation[m] for m in METRICS},
        "confusion_matrix": evaluation["confusion_matrix"],
        "training_seconds": tuning["training_seconds"], "prediction_seconds": prediction_seconds,
    }
    if isinstance(model, KnnModel):
        document["decision_rule"] = "argmax_probability"
    else:
        document["decision_threshold"] = model.threshold
    if isinstance(model, NetworkModel):
        document["architecture"] = ARCHITECTURE | {"tasks": model.tasks}
        document["training_history"] = {
            "epochs_completed": model.epochs_completed,
            "best_validation_score": model.best_validation_score}
    if isinstance(model, ForestModel):
        ranked = feature_importances(spark, model, list(selected)).collect()
        document["feature_importances"] = [r.asDict() for r in ranked]
    return spark.createDataFrame([document], RESULT_DDL)


def train_and_evaluate(
    df: DataFrame, profile: FlowProfile, key: str, seed: int = 42,
    models: Sequence[str] = MODEL_ORDER, candidates: dict | None = None,
    tuning_rows: dict | None = None, settings: dict | None = None, **preparation,
) -> tuple[Detector, DataFrame]:
    """Tune, fit and test models on one dataset and seed: a detector and its documents."""
    spark = df.sparkSession
    preprocessor, train, test = prepare(df, profile, key, seed, **preparation)
    detector, documents = Detector(profile, preprocessor), None
    training_rows = train.count()
    options = {name: (settings or {}).get(name, {}) for name in models}
    sharing = [name for name in models if shares_scans(name, options[name]) and "folds" not in options[name]]
    # The linear models' folds are dealt and packed once for all of their searches and refits.
    packed = packed_folds(train, key, seed=seed) if sharing else None
    for name in models:
        model, tuning = tune_and_fit(
            train, name, key, (candidates or {}).get(name), (tuning_rows or {}).get(name),
            seed=seed, packed=packed if name in sharing else None, **options[name])
        detector.models[name] = model
        scored, seconds = run_timed(
            lambda: materialise(model.attach(test, "score", "prediction").select(
                "label", "score", "prediction"), "scored"))
        row = evaluate(scored, "label", {name: "prediction"}, {name: "score"}).head().asDict(True)
        document = result_document(
            spark, profile, name, model, tuning, preprocessor.selected, training_rows, row, seconds)
        documents = document if documents is None else documents.unionByName(document)
    if packed is not None:
        packed.release()
    return detector, documents


def _stored(df: DataFrame | None, profile: FlowProfile, key: str) -> DataFrame | None:
    """The usable rows' columns that the runs over a dataset read, written once."""
    if df is None:
        return None
    names = dict.fromkeys([key, *profile.features, profile.label])
    return materialise(usable_rows(df, profile.features).select(*[col(c) for c in names]), "study-rows", spread=True)


def run_study(
    datasets: Sequence[tuple[DataFrame, FlowProfile]], key: str,
    seeds: Sequence[int] = STUDY_SEEDS, parallelism: int = 4, **training,
) -> DataFrame:
    """Result documents of every dataset and seed, with columns run and seed.

    So many of them are worked on side by side; with 1 the recorded seconds are those of a fit
    that has the cluster to itself. The columns that a dataset's runs read are written once for all of them.
    """
    if len(seeds) > 1:
        datasets = [(_stored(df, profile, key), profile) for df, profile in datasets]

    def documents(item: tuple[int, int, tuple[DataFrame, FlowProfile]]) -> DataFrame:
        number, seed, (df, profile) = item
        _, found = train_and_evaluate(df, profile, key, seed, **training)
        return found.withColumns({"run": F.lit(f"run_{number}"), "seed": F.lit(seed)})

    runs = [(number, seed, dataset) for number, seed in enumerate(seeds, start=1) for dataset in datasets]
    with ThreadPoolExecutor(parallelism) as pool:
        found = reduce(DataFrame.unionByName, pool.map(documents, runs))
    for df, _ in datasets:
        if df is not None:
            release(df)
    return found


def study_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flat run table and its statistics."""
    runs = run_table(documents)
    if "seed" in documents.columns:
        runs = run_table(documents).drop("seed").join(
            documents.select("run", "seed").distinct(), "run").select(*runs.columns)
    return runs, run_statistics(runs)


def run_statistics(
    runs: DataFrame, metrics: Sequence[str] = (*METRICS, *TIMINGS)
) -> DataFrame:
    """Number of runs, mean and sample deviation of each metric, by dataset and model."""
    return (
        runs.groupBy("dataset", "model")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            *[e for m in metrics for e in (
                F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))],
        )
        .orderBy("dataset", "model")
    )


def selection_stability(documents: DataFrame) -> DataFrame:
    """How often each feature was chosen over the runs, and its mean importance."""
    exploded = documents.select("dataset", F.explode("feature_importances").alias("f"))
    return exploded.groupBy("dataset", F.col("f.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("times_selected"), F.avg("f.importance").alias("mean_importance"))
