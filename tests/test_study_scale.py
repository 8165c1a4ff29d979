"""The study over several seeds: sampling, linear fits, runs."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import classifiers, newton, sampling, tuning
from flowsentry.plans import study
from flowsentry.profiles import FlowProfile


def test_linear_fits_scan_packed_rows():
    rng = np.random.default_rng(4)
    x, y, fold = rng.random((9_000, 3)).astype(np.float32), rng.integers(0, 2, 9_000), rng.integers(0, 3, 9_000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(list(x), pa.list_(pa.float32())), pa.array(y, pa.int32()), pa.array(fold, pa.int32())], ["features", "label", "fold"])
    packed = list(newton.pack_rows(iter([batch])))
    assert sum(p.num_rows for p in packed) == 3
    weights = rng.normal(size=(2, 4))
    (out,) = newton.scan_task(weights, [1, None], "logistic")(iter(packed))
    got = np.frombuffer(out.column("v")[0].as_py()).reshape(2, -1)
    for p, left_out in enumerate((1, -1)):
        kept = fold != left_out
        wide = newton.with_intercept(x[kept])
        value, first, second = newton.losses(wide @ weights[p], y[kept], "logistic")
        curvature = (wide.T * second) @ wide
        assert np.allclose(got[p], [value.sum(), *(first @ wide), *curvature[np.triu_indices(4)]])


def test_runs_of_a_study_go_side_by_side(spark, monkeypatch):
    """Two runs that wait for each other both end, in their order."""
    together = threading.Barrier(2, timeout=60)

    def fitted(df, profile, key, seed):
        together.wait()
        return None, spark.createDataFrame([(profile, seed)], "dataset string, s int")

    monkeypatch.setattr(study, "train_and_evaluate", fitted)
    runs = study.run_study([(None, "a"), (None, "b")], "id", seeds=(7, 8)).collect()
    assert [(r.dataset, r.s, r.run, r.seed) for r in runs] == [
        ("a", 7, "run_1", 7), ("b", 7, "run_1", 7), ("a", 8, "run_2", 8), ("b", 8, "run_2", 8)]


def test_classes_beyond_the_limit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_CLASSES", 3)
    rows = spark.range(40).withColumn("label", F.col("id") % 4)
    with pytest.raises(ValueError, match="more than 3 classes"):
        sampling.stratified_split(rows, "id", "label")
    train, test = sampling.stratified_split(rows.filter("label < 3"), "id", "label")
    assert (train.count(), test.count()) == (21, 9)


def _learnable(spark, n=1_200):
    rng = np.random.default_rng(6)
    x = rng.random((n, 3)).astype(np.float32)
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.3, n) > 0.7).astype(int)
    rows = [(i, int(label), [float(v) for v in values]) for i, (label, values) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, label int, features array<float>")


def test_linear_models_of_a_run_share_packed_rows(spark, monkeypatch):
    """One packing for the searches and refits of both models, and a refit that starts from the folds' weights."""
    train, made, pack = _learnable(spark), [], newton.pack
    alone = classifiers.fit_logistic(train, 10.0)
    monkeypatch.setattr(tuning, "pack", lambda table: made.append(pack(table)) or made[-1])
    packed = tuning.packed_folds(train, "id")
    for name in ("Logistic Regression", "Linear SVM"):
        model, found = tuning.tune_and_fit(train, name, "id", [{"C": 10.0}], packed=packed)
        assert model.converged and found["candidates"][0]["mean_f1_score"] > 0.7
        if name == "Logistic Regression":
            assert model.scans < alone.scans
            assert np.allclose([*model.weights, model.intercept], [*alone.weights, alone.intercept], atol=1e-3)
    assert len(made) == 1


def test_large_solves_start_from_a_few_blocks(spark, monkeypatch):
    """Fewer scans of the whole for the same weights, also where no few blocks can be had."""
    monkeypatch.setattr(newton, "ROWS_AT_ONCE", 5)
    folded = sampling.assign_folds(_learnable(spark), "id", "label")
    problems = [newton.Problem(c, fold) for c in (0.1, 10.0) for fold in (0, 1, None)]
    for kind in ("logistic", "squared_hinge"):
        whole = newton.solve(folded, problems, kind)
        monkeypatch.setattr(newton, "FEW_BLOCKS", 50)
        few = newton.solve(folded, problems, kind)
        monkeypatch.undo()
        monkeypatch.setattr(newton, "ROWS_AT_ONCE", 5)
        assert whole.converged.all() and few.converged.all() and few.scans < whole.scans
        assert np.allclose(whole.weights, few.weights, atol=1e-3)


def test_a_bad_start_is_given_up(spark):
    folded = sampling.assign_folds(_learnable(spark), "id", "label")
    packed = newton.pack(folded)
    packed.starts["logistic", 10.0] = np.full(4, -1e6)
    with np.errstate(all="ignore"):
        found = newton.solve(folded, [newton.Problem(10.0)], "logistic", packed=packed)
    assert found.converged.all()
    assert np.allclose(found.weights, newton.solve(folded, [newton.Problem(10.0)], "logistic").weights, atol=1e-3)


@pytest.mark.parametrize("bucket, together", [(2000, 50_000), (3, 0)])
def test_cutoffs_of_hashes_as_bytes(spark, monkeypatch, bucket, together):
    """Hashes as bytes give the cuts that their hex digits give, found in buckets or level by level."""
    monkeypatch.setattr(sampling, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(sampling, "COLLECT_ROWS", together)
    rows = spark.range(30_000).select(
        "id", (F.col("id") % 3 == 0).alias("label"), F.md5(F.col("id").cast("string")).alias("text"),
    ).withColumn("bytes", F.unhex("text"))
    ranks = lambda sizes: {c: [0, 1, s // 2, s] for c, s in sizes.items()}
    cuts = sampling.hash_cutoffs(rows, F.col("bytes"), F.col("label"), ranks)
    assert cuts == sampling.hash_cutoffs(rows, F.col("text"), F.col("label"), ranks)
    texts = {c: sorted(r.text for r in rows.filter(F.col("label") == c).collect()) for c in (True, False)}
    assert cuts == {c: ["", t[0], t[len(t) // 2 - 1], "g"] for c, t in texts.items()}
    both = rows.select(*[sampling._below(F.col(c), F.col("label"), cuts, which, c == "bytes").alias(f"{c}{which}")
                         for c in ("text", "bytes") for which in range(4)])
    assert both.filter(" or ".join(f"text{w} <> bytes{w}" for w in range(4))).count() == 0
    assert [both.filter(f"bytes{w}").count() for w in range(4)] == [0, 2, 15_000, 30_000]


def test_a_study_reads_its_source_once(spark, monkeypatch):
    monkeypatch.setattr(study, "train_and_evaluate", lambda df, profile, key, seed: (
        None, spark.createDataFrame([(df.count(), len(df.inputFiles()))], "n long, files int")))
    profile = FlowProfile("p", "p", ("a",), label="y")
    rows = spark.range(10).selectExpr("id", "id * 1.0D as a", "1 as y", "'x' as unused").withColumn(
        "a", F.when(F.col("id") > 0, F.col("a")))
    found = study.run_study([(rows, profile)], "id", seeds=(1, 2)).collect()
    assert [r.n for r in found] == [9, 9] and all(r.files > 0 for r in found)
