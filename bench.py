"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from flowsentry.functions.session import build_session, materialise
from flowsentry.operators import classifiers, knn, metrics, mlp, tuning
from flowsentry.plans import catalog, study, surrogate

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Queries from the catalogue, run to the last row.
QUERIES = (
    "attack_summary", "flow_predictions", "training_clean", "min_max_scaling", "one_hot_encoding",
    "anova_f_scores", "mutual_information", "stratified_split", "undersampled_train",
    "stratified_folds", "detection_metrics", "ranking_metrics", "run_statistics", "csv_flow_scan",
    "streamed_scores",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action):
    start = time.perf_counter()
    result = action()
    return result, round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="20g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}
    quality: dict[str, float] = {}

    run(catalog.QUERIES["feature_matrix"](spark, SF_DIR))  # warm-up
    for name in QUERIES:
        _, seconds[name] = timed(lambda: run(catalog.QUERIES[name](spark, SF_DIR)))

    # Shipments stand in for flows: 20 encoded columns, about as many rows as the smaller recorded study.
    shipped = surrogate.wide_shipments(spark, SF_DIR)
    (preprocessor, train, test), seconds["prepare"] = timed(
        lambda: study.prepare(shipped, surrogate.WIDE, "row_key"))
    rows = test.count()
    fits = {
        "logistic": lambda: classifiers.fit_logistic(train, 1.0),
        "linear_svm": lambda: classifiers.fit_linear_svm(train, 1.0),
        "forest_150x20": lambda: classifiers.fit_forest(train, n_estimators=150, max_depth=20),
        "network": lambda: mlp.fit_mlp_adam(train, "row_key"),
        "knn": lambda: knn.fit_knn(train, "row_key", 5, "distance"),
    }
    for name, fit in fits.items():
        model, seconds[f"fit_{name}"] = timed(fit)
        _, seconds[f"predict_{name}"] = timed(  # every score is computed, nothing is stored
            lambda: model.attach(test, "s", "p").agg(F.sum("s"), F.sum("p")).collect())
        scored = materialise(model.attach(test, "s", "p").select("label", "s", "p"), "scored")
        rates[f"predict_{name}_rows_per_sec"] = int(rows / seconds[f"predict_{name}"])
        row, seconds[f"evaluate_{name}"] = timed(
            lambda: metrics.evaluate(scored, "label", {name: "p"}, {name: "s"}).head())
        quality[f"{name}_f1"] = round(row.f1_score, 4)
        if name == "network":
            seconds["fit_network_per_epoch"] = round(seconds["fit_network"] / max(1, model.epochs_completed), 3)
    for model in ("Logistic Regression", "Linear SVM", "kNN"):
        key = ("grid_14x3_" if model == "kNN" else "grid_7x3_") + model.lower().replace(" ", "_")
        _, seconds[key] = timed(lambda: tuning.grid_search(train, model, "row_key").collect())

    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(v for k, v in seconds.items() if k != "fit_network_per_epoch"), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
        "training_rows": train.count(), "testing_rows": rows,
        "input_features": len(preprocessor.selected), "rates": rates, "quality": quality,
    }))


if __name__ == "__main__":
    main()
