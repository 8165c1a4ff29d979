import json

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from flowsentry.operators import classifiers, knn, mlp, newton, tuning
from flowsentry.operators.sampling import assign_folds
from flowsentry.plans import study, surrogate
from flowsentry.plans.analyze import analyze
from flowsentry.profiles import COMPARE_ALL, DOCUMENT_NAMES, MODEL_ORDER
from flowsentry.sources import results as rs, store
from flowsentry.streaming import scoring as streams


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.random((1500, 3)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.1 * rng.standard_normal(1500) > 0.8).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, label int, features array<float>").persist()


def objective(rows, weights, intercept, c, kind):
    x = np.array([r.features for r in rows])
    y = np.array([r.label for r in rows])
    loss, _, _ = newton.losses(x @ np.array(weights) + intercept, y, kind)
    return 0.5 * np.dot(weights, weights) + c * loss.sum()


@pytest.mark.parametrize("c", [1.0, 1000.0])
def test_newton_finds_the_logistic_optimum(data, c):
    rows = data.collect()
    mine = classifiers.fit_logistic(data, c)
    library = classifiers.fit_logistic(data, c, "lbfgs")
    a, b = (objective(rows, m.weights, m.intercept, c, "logistic") for m in (mine, library))
    assert a <= b * (1 + 1e-7)
    assert mine.weights == pytest.approx(library.weights, rel=0.02, abs=0.02)


def test_newton_svm_has_no_descent_direction(data):
    rows = data.collect()
    m = classifiers.fit_linear_svm(data, 1.0)
    best = objective(rows, m.weights, m.intercept, 1.0, "squared_hinge")
    rng = np.random.default_rng(0)
    for _ in range(50):
        step = rng.standard_normal(4) * 1e-3
        other = objective(rows, np.array(m.weights) + step[:3], m.intercept + step[3], 1.0, "squared_hinge")
        assert other >= best - 1e-9


def test_many_problems_equal_single_fits(data):
    folded = assign_folds(data, "id", "label")
    problems = [newton.Problem(1.0, 0), newton.Problem(10.0, 2)]
    together = newton.solve(folded, problems, "logistic").weights
    for problem, weights in zip(problems, together):
        alone = classifiers.fit_logistic(folded.filter(F.col("fold") != problem.without_fold), problem.c)
        assert list(weights) == pytest.approx([*alone.weights, alone.intercept], rel=1e-5)


def test_shared_grid_equals_library_cross_validation(data):
    candidates = [{"C": 0.1}, {"C": 10.0}]
    mine = tuning.grid_search(data, "Logistic Regression", "id", candidates).orderBy("candidate").collect()
    theirs = tuning.grid_search(
        data, "Logistic Regression", "id", candidates, solver="lbfgs").orderBy("candidate").collect()
    assert [r.mean_f1_score for r in mine] == pytest.approx([r.mean_f1_score for r in theirs], abs=0.01)


def test_network_learns_and_repeats(spark, data):
    fits = [mlp.fit_mlp_adam(data, "id", max_epochs=12, tasks=2) for _ in range(2)]
    assert np.array_equal(fits[0].weights, fits[1].weights)
    assert fits[0].best_validation_score > 0.85
    history = fits[0].epoch_history(spark).orderBy("epoch").collect()
    assert len(history) == fits[0].epochs_completed == 12 and history[-1].loss < history[0].loss
    assert fits[0].training_history(spark).head().epochs_completed == 12


def test_network_depends_on_tasks_alone(spark, data):
    first = mlp.fit_mlp_adam(data, "id", max_epochs=3, tasks=3)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = mlp.fit_mlp_adam(data.repartition(5), "id", max_epochs=3, tasks=3)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first.tasks == 3 and np.array_equal(first.weights, again.weights)
    assert not np.array_equal(first.weights, mlp.fit_mlp_adam(data, "id", max_epochs=3, tasks=1).weights)


def test_workers_follow_the_rows():
    assert [mlp.tasks_for(n) for n in (0, 200, 16_384, 139_686, 10 ** 9)] == [1, 1, 1, 8, 64]


def test_newton_says_whether_it_converged(data):
    full, cut = classifiers.fit_logistic(data, 1.0), classifiers.fit_logistic(data, 1.0, max_iter=2)
    assert full.converged and full.scans > 2 and not cut.converged and cut.scans == 2


def test_recorded_forest_parameters_are_those_applied():
    for candidate in classifiers.FOREST_CANDIDATES:
        assert classifiers.applied_parameters("Random Forest", dict(candidate)) == candidate
    applied = classifiers.applied_parameters("Random Forest", dict(classifiers.FOREST_CANDIDATES[3]), "library")
    assert applied["max_depth"] == 30 and applied["min_samples_split"] == 2
    with pytest.raises(ValueError):
        classifiers.forest_estimator(max_depth=31)


def test_network_stops_early(data):
    assert mlp.fit_mlp_adam(data, "id", max_epochs=40, patience=1, tasks=1).epochs_completed < 40


def test_network_gradient():
    rng = np.random.default_rng(2)
    layers = [3, 5, 1]
    flat, x, y = mlp.initial_weights(layers, 0), rng.random((8, 3)), rng.integers(0, 2, 8).astype(float)

    def cost(w):
        parts = mlp.unpack(w, layers)
        weights = sum(float(np.sum(p * p)) for p in parts[::2])
        return mlp.gradient(x, y, parts, 0.1)[0] / 8 + 0.1 / 2 * weights / 8

    _, g = mlp.gradient(x, y, mlp.unpack(flat, layers), 0.1)
    for i in range(0, len(flat), 5):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert g[i] == pytest.approx((cost(flat + step) - cost(flat - step)) / 2e-6, abs=1e-5)


def test_candidates():
    assert [len(tuning.candidates_of(m)) for m in MODEL_ORDER] == [6, 7, 7, 14, 4]
    assert tuning.TUNING_ROWS == {"Random Forest": 80_000, "kNN": 50_000, "ANN": 80_000}


# ---- whole runs on the event surrogate ----

CANDIDATES = {
    "Random Forest": [{"n_estimators": 5, "max_depth": d, "min_samples_split": 2, "min_samples_leaf": 1,
                       "max_features": "sqrt"} for d in (3, None)],
    "Logistic Regression": [{"C": 1.0}, {"C": 100.0}],
    "Linear SVM": [{"C": 1.0}],
    "kNN": [{"n_neighbors": k, "weights": w} for k in (3, 5) for w in ("uniform", "distance")],
    "ANN": [{"alpha": 1e-4}],
}


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    events = surrogate.events(spark, sf_dir)
    return study.train_and_evaluate(
        events, surrogate.EVENTS, "row_id", seed=13, candidates=CANDIDATES, k=6,
        settings={"ANN": {"max_epochs": 3}})


def test_result_documents(spark, trained, tmp_path):
    detector, documents = trained
    rs.write_results(documents.withColumn("run", F.lit("run_2")), str(tmp_path / "r"))
    back = rs.read_documents(spark, str(tmp_path / "r"))
    rows = {DOCUMENT_NAMES.get(r.model, r.model): r for r in back.collect()}
    assert set(rows) == set(MODEL_ORDER) and {r.run for r in rows.values()} == {"run_2"}
    forest, network = rows["Random Forest"], rows["ANN"]
    assert len(forest.feature_importances) == forest.input_features == 6
    assert sum(f.importance for f in forest.feature_importances) == pytest.approx(1)
    assert forest.cross_validation.candidate_count == 2
    assert network.architecture.hidden_layers == [128, 64] and network.training_history.epochs_completed == 3
    assert rows["kNN"].decision_threshold is None and rows["kNN"].decision_rule
    assert rows["Linear SVM"].decision_threshold == 0.0
    assert set(rows["Logistic Regression"].cross_validation.mean_f1_scores) == {"1.0", "100.0"}
    for r in rows.values():
        (tn, fp), (fn, tp) = r.confusion_matrix
        assert tn + fp + fn + tp == r.testing_rows
        assert r.metrics.accuracy == pytest.approx((tn + tp) / r.testing_rows)
    table = rs.run_table(back)
    assert {r.seed for r in table.collect()} == {13}
    assert list(detector.models) == list(MODEL_ORDER)


def test_saved_detector_scores_the_same(spark, sf_dir, trained, tmp_path):
    detector, _ = trained
    store.save_pipeline(spark, detector, str(tmp_path))
    loaded = store.load_pipeline(spark, str(tmp_path), surrogate.EVENTS)
    assert store.load_pipeline(spark, str(tmp_path), surrogate.EVENTS) is loaded
    events = surrogate.events(spark, sf_dir)
    a, b = (d.score(events, COMPARE_ALL).orderBy("row_id").toPandas() for d in (detector, loaded))
    assert a.equals(b) and [c for c in a.columns if c.startswith("Prediction")] == [
        "Prediction_Random_Forest", "Prediction_Logistic_Regression", "Prediction_Linear_SVM",
        "Prediction_kNN", "Prediction_ANN"]


def test_file_stream_and_batch_agree(spark, sf_dir, trained, tmp_path):
    detector, _ = trained
    folder = str(tmp_path / "in")
    surrogate.events(spark, sf_dir).repartition(3).write.csv(folder, header=True)
    batch = analyze(spark, folder, detector, "ANN", str(tmp_path / "scored"))
    assert batch.preview.columns == ["Prediction", "event_type", "value", "hour"]
    header = surrogate.events(spark, sf_dir).columns
    scored = streams.score_stream(spark, folder, header, detector, "ANN")
    streams.available_now(scored, str(tmp_path / "state")).format("parquet").start(
        str(tmp_path / "out")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    columns = ["row_id", "Prediction"]
    a, b = (sorted(map(tuple, d.select(columns).collect())) for d in (batch.scored, streamed))
    assert a == b and len(a) == batch.summary.head().rows


def test_stream_refuses_another_header(spark, sf_dir, trained, tmp_path):
    detector, _ = trained
    folder = str(tmp_path / "in")
    events = surrogate.events(spark, sf_dir)
    events.select(*reversed(events.columns)).write.csv(folder, header=True)
    scored = streams.score_stream(spark, folder, events.columns, detector, "Linear SVM")
    query = streams.available_now(scored, str(tmp_path / "state")).format("parquet").start(str(tmp_path / "out"))
    with pytest.raises(Exception):
        query.awaitTermination()


def test_parameters_are_json(data):
    scores = tuning.grid_search(data, "Linear SVM", "id", [{"C": 1.0}]).head()
    assert json.loads(scores.parameters) == {"C": 1.0}


def test_too_many_neighbours(data):
    index = knn.KnnIndex.fit(data, "id", 3)
    with pytest.raises(ValueError):
        index.search(data, "id", 4)


def test_library_models_score_in_a_session_with_observations(spark):
    """Fitted models must not hold on to a session that cannot be sent to the executors."""
    session = spark.newSession()
    seen = Observation()
    session.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    rows = session.createDataFrame([(float(i % 2), [float(i % 2), float(i % 3)]) for i in range(40)], "label double, features array<double>")
    train = classifiers.with_vector(rows)
    for estimator in (classifiers.logistic_estimator(1.0, 40, 5), classifiers.svm_estimator(1.0, 40, 5),
                      classifiers.forest_estimator(n_estimators=3, max_depth=3)):
        assert estimator.fit(train).transform(train).filter("prediction = label").count() == 40
