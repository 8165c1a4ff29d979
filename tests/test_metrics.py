import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import metrics as mx, scoring, tuning
from flowsentry.plans import study
from flowsentry.profiles import COMPARE_ALL, MODEL_ORDER
from flowsentry.sources import results as rs

TIED = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (1, 0.2)]


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame(TIED, "label int, score double")


@pytest.mark.parametrize("ranges", [1, 2, 3, 64])
def test_tied_scores(spark, tied, ranges, monkeypatch):
    cut = type(tied).repartitionByRange
    monkeypatch.setattr(type(tied), "repartitionByRange", lambda df, *by: cut(df, ranges, *by))
    row = mx.ranking_metrics(tied, "label", {"m": "score"}).head()
    assert row.roc_auc == pytest.approx(0.416667, abs=1e-6)
    assert row.average_precision == pytest.approx(0.7)


def test_auc_does_not_change_under_a_monotone_map(tied):
    mapped = tied.withColumn("score", F.exp(F.col("score") * 7) - 100)
    a, b = (mx.ranking_metrics(d, "label", {"m": "score"}).head() for d in (tied, mapped))
    assert a == b


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.7, 0)], "label int, score double, p int")
    row = mx.evaluate(df, "label", {"m": "p"}, {"m": "score"}).head()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (1.0, 0.0, 0.0, 0.0)
    assert row.roc_auc is None and row.average_precision == 0.0


# Recorded confusion matrices [tn, fp, fn, tp] and the metrics of each run.
RECORDED = [
    ([19220, 6372, 2320, 18069], 0.8109653987516583, 0.7392905363937646, 0.8862131541517485,
     0.8061119785857684, 0.24898405751797437),
    ([23512, 2080, 1623, 18766], 0.9194667362606294, 0.9002206658351722, 0.9203982539604689,
     0.910197647629441, 0.08127539856205064),
    ([22975, 2617, 1955, 18434], 0.9005676257584655, 0.8756828654220702, 0.9041149639511501,
     0.8896718146718147, 0.10225851828696468),
]


@pytest.mark.parametrize("cells,accuracy,precision,recall,f1,fpr", RECORDED)
def test_recorded_metrics(spark, cells, accuracy, precision, recall, f1, fpr):
    row = mx.metrics(spark.createDataFrame([tuple(cells)], "tn long, fp long, fn long, tp long")).head()
    found = (row.accuracy, row.precision, row.recall, row.f1_score, row.false_positive_rate)
    assert found == pytest.approx((accuracy, precision, recall, f1, fpr), abs=1e-12)


def test_attack_rate_rounds_half_to_even(spark):
    df = spark.range(800).select(F.when(F.col("id") == 0, "Attack").otherwise("Normal").alias("Prediction"))
    row = scoring.summary(df, {"m": "Prediction"}).head()
    assert (row.rows, row.normal, row.attack, row.attack_rate) == (800, 799, 1, 0.12)
    shares = scoring.class_shares(scoring.summary(df, {"m": "Prediction"})).head()
    assert (shares.normal_share, shares.attack_share) == (99.9, 0.1)


def test_prediction_names():
    models = dict.fromkeys(reversed(MODEL_ORDER))
    assert scoring.prediction_columns(models, "kNN") == {"kNN": "Prediction"}
    assert list(scoring.prediction_columns(models, COMPARE_ALL).values())[:2] == [
        "Prediction_Random_Forest", "Prediction_Logistic_Regression"]
    with pytest.raises(KeyError):
        scoring.prediction_columns(models, "other")


def test_first_candidate_wins_ties(spark):
    scores = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.7), (2, "c", 0.7)], tuning.SCORE_SCHEMA)
    assert tuning.select_best(scores).head().parameters == "b"


def document(run, dataset, model, accuracy):
    return {"dataset": dataset, "model": model, "testing_rows": 10, "metrics": {"accuracy": accuracy},
            "training_seconds": 1.0, "prediction_seconds": 0.5}, run


def test_documents_to_tables(spark, tmp_path):
    for run, dataset, accuracy in ((1, "A", 0.5), (2, "A", 0.75), (1, "B", 1.0)):
        doc, _ = document(run, dataset, "k-Nearest Neighbors", accuracy)
        folder = tmp_path / f"run_{run}" / "results" / "knn"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{dataset}_results.json").write_text(json.dumps(doc, indent=1))
    table = rs.read_results(spark, str(tmp_path))
    assert tuple(table.columns) == rs.RUN_COLUMNS
    rows = rs.run_order(table).collect()
    assert [(r.run, r.seed, r.dataset, r.model) for r in rows] == [
        ("run_1", 42, "A", "kNN"), ("run_1", 42, "B", "kNN"), ("run_2", 13, "A", "kNN")]
    stats = study.run_statistics(table).collect()
    assert (stats[0].runs, stats[0].accuracy_mean) == (2, 0.625)
    assert stats[0].accuracy_std == pytest.approx(0.1767766952966369) and stats[1].accuracy_std is None


def test_summary_documents(spark, tmp_path):
    rows = [("run_1", "B", "ANN", 2), ("run_1", "A", "ANN", 1)]
    documents = spark.createDataFrame(rows, "run string, dataset string, model string, testing_rows long")
    row = rs.summarise_results(documents).head()
    assert list(row.datasets) == ["A", "B"] and row.datasets["B"].testing_rows == 2


def test_selection_stability(spark):
    ddl = "dataset string, feature_importances array<struct<feature: string, importance: double>>"
    df = spark.createDataFrame([("A", [("x", 0.5), ("y", 0.5)]), ("A", [("x", 1.0)])], ddl)
    rows = {r.feature: (r.times_selected, r.mean_importance) for r in study.selection_stability(df).collect()}
    assert rows == {"x": (2, 0.75), "y": (1, 0.5)}


RESULTS_ROOT = os.environ.get("STUDY_RESULTS_DIR", "")


@pytest.mark.skipif(not RESULTS_ROOT, reason="STUDY_RESULTS_DIR is not set")
def test_recorded_study(spark):
    """A recorded study: documents give its run table, and that its statistics table."""
    runs = rs.read_results(spark, RESULTS_ROOT)
    recorded = spark.read.csv(os.path.join(RESULTS_ROOT, "per_run_metrics.csv"), header=True)
    mine = {(r.run, r.dataset, r.model): r for r in runs.collect()}
    theirs = recorded.toPandas().to_dict("records")
    assert len(mine) == len(theirs) == 50
    for row in theirs:
        found = mine[(row["run"], row["dataset"], row["model"])]
        assert found.seed == int(row["seed"]) and found.testing_rows == int(row["testing_rows"])
        for m in (*rs.METRICS, *rs.TIMINGS):
            assert found[m] == float(row[m])
    stats = {(r.dataset, r.model): r for r in study.run_statistics(runs).collect()}
    tables = spark.read.csv(os.path.join(RESULTS_ROOT, "mean_std_metrics.csv"), header=True).toPandas()
    assert len(tables) == len(stats) == 10
    for row in tables.to_dict("records"):
        for name in tables.columns[3:]:
            assert stats[(row["dataset"], row["model"])][name] == pytest.approx(float(row[name]), abs=1e-9)
    documents = rs.read_documents(spark, RESULTS_ROOT)
    cells = documents.select("metrics", *[
        F.col("confusion_matrix")[i][j].alias(n)
        for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    for row in mx.metrics(cells).collect():
        for m in ("accuracy", "precision", "recall", "f1_score", "false_positive_rate"):
            assert row[m] == pytest.approx(row.metrics[m], abs=1e-12)
    importances = documents.filter("feature_importances is not null")
    sums = importances.select(F.aggregate("feature_importances", F.lit(0.0), lambda s, f: s + f["importance"]).alias("s"))
    assert all(r.s == pytest.approx(1, abs=1e-9) for r in sums.collect()) and importances.count() == 10
    assert len(glob.glob(os.path.join(RESULTS_ROOT, "run_*"))) == 5
