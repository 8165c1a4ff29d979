import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import features as fx, sampling
from flowsentry.profiles import FlowProfile

PROFILE = FlowProfile("t", "t", ("x", "kind", "c"), ("kind",))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(float(i), "-" if i % 3 else "http", 7.0, int(i >= 10)) for i in range(20)]
    return spark.createDataFrame(rows, "x double, kind string, c double, label int")


def test_one_hot_names_and_unseen_levels(spark, frame):
    encoder = fx.FlowEncoder.fit(frame, PROFILE)
    assert encoder.names == ["x", "kind_-", "kind_http", "c"]
    new = spark.createDataFrame([(1.0, "ftp", 7.0), (2.0, "-", 7.0)], "x double, kind string, c double")
    cells = encoder.expressions()
    row = new.select(cells["kind_-"].alias("a"), cells["kind_http"].alias("b")).collect()
    assert [tuple(r) for r in row] == [(0.0, 0.0), (1.0, 0.0)]
    assert encoder.unseen_counts(new).head().unseen_rows == 1


def test_too_many_levels(frame):
    with pytest.raises(ValueError):
        fx.FlowEncoder.fit(frame, PROFILE, max_levels=1)


def test_scaling_constant_and_out_of_range(spark, frame):
    encoder = fx.FlowEncoder.fit(frame, PROFILE)
    scaler = fx.FlowScaler.fit(frame, encoder)
    new = spark.createDataFrame([(38.0, "-", 9.0)], "x double, kind string, c double")
    scaled = fx.scaled_columns(encoder, scaler)
    row = new.select(scaled["x"].alias("x"), scaled["c"].alias("c")).head()
    assert (row.x, row.c) == (2.0, 0.0)
    train = frame.select(*[c.alias(n) for n, c in scaled.items()]).toPandas()
    assert train.min().min() >= 0 and train.max().max() <= 1


def test_preprocessor_json_round_trip(frame):
    fitted = fx.FlowPreprocessor.fit(frame, PROFILE, k=2)
    again = fx.FlowPreprocessor.from_json(fitted.to_json())
    assert again == fitted and "x" in fitted.selected
    a, b = (p.transform(frame).select("features").collect() for p in (fitted, again))
    assert a == b and len(a[0].features) == 2


@pytest.mark.parametrize("method", ["anova", "mutual_information", "forest"])
def test_selection_finds_the_signal(frame, method):
    fitted = fx.FlowPreprocessor.fit(frame, PROFILE, k=1, method=method)
    assert fitted.selected == ["x"]


def test_anova_without_spread(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 1.0, 5.0), (1, 2.0, 5.0), (1, 2.0, 5.0)], "y int, a double, b double")
    scores = {r.feature: r.f_score for r in fx.anova_f_scores(df, {"a": F.col("a"), "b": F.col("b")}, "y").collect()}
    assert scores == {"a": float("inf"), "b": 0.0}


# ---- sampling ----

@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(1000).select(F.col("id"), (F.col("id") < 300).cast("int").alias("label")).persist()


def test_split_is_disjoint_complete_and_exact(keyed):
    train, test = sampling.stratified_split(keyed, "id", "label")
    assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {0: 490, 1: 210}
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == 1000


# Class sizes of the two datasets, and the recorded training and test sizes.
@pytest.mark.parametrize("normal,attack,training,testing", [
    (2_094_361, 425_044, 595_062, {0: 628_309, 1: 127_513}),
    (85_307, 67_962, 95_146, {0: 25_592, 1: 20_389}),
])
def test_split_and_balance_sizes_of_the_recorded_study(normal, attack, training, testing):
    sizes = {0: normal, 1: attack}
    train = sampling.split_shares(sizes, 0.7)
    assert {c: sizes[c] - train[c] for c in sizes} == testing
    assert 2 * min(train.values()) == training


def test_undersampled_classes_are_equal(keyed):
    counts = sampling.undersample(keyed, "id", "label").groupBy("label").count().collect()
    assert {r["count"] for r in counts} == {300}


def test_subsample_size(keyed):
    assert sampling.subsample(keyed, 101, "id", "label").count() == 101
    assert sampling.subsample(keyed, 101, "id").count() == 101
    assert sampling.subsample(keyed, 5000, "id", "label").count() == 1000


def test_shares_add_up():
    assert sampling.proportional_shares({0: 7, 1: 3}, 5) == {0: 4, 1: 1}
    assert sum(sampling.proportional_shares({0: 10, 1: 11, 2: 12}, 10).values()) == 10


def test_folds_are_even_per_class(keyed):
    folded = sampling.assign_folds(keyed, "id", "label")
    sizes = folded.groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in sizes} <= {(1, 100), (0, 233), (0, 234)} and len(sizes) == 6


def test_cutoffs_descend_into_large_buckets(keyed, monkeypatch):
    expected = sampling.stratified_split(keyed, "id", "label")[0].orderBy("id").collect()
    monkeypatch.setattr(sampling, "DIGITS", 1)
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 2)
    assert sampling.stratified_split(keyed, "id", "label")[0].orderBy("id").collect() == expected


def test_equal_keys_over_a_cut_are_refused(spark):
    same = spark.range(50).select(F.lit(1).alias("id"), F.lit(0).alias("label"))
    with pytest.raises(ValueError, match="unique"):
        sampling.subsample(same, 10, "id", "label")
    assert sampling.subsample(same, 50, "id", "label").count() == 50


def test_rows_without_label_are_in_no_part(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, (F.col("id") % 2).cast("int")).alias("label"))
    train, test = sampling.stratified_split(df, "id", "label")
    assert train.count() + test.count() == 90
    assert sampling.assign_folds(df, "id", "label").filter("label is null and fold is not null").count() == 0


def test_too_many_classes_are_refused_first(spark):
    with pytest.raises(ValueError, match="classes"):
        sampling.stratified_split(spark.range(2000).select("id", F.col("id").alias("label")), "id", "label")


def test_median_agrees_with_numpy(keyed):
    order = F.col("id").cast("string")
    cut = sampling.hash_cutoffs(keyed, F.md5(order), F.lit(0), lambda n: {0: [500]})[0][0]
    hashes = sorted(r.h for r in keyed.select(F.md5(order).alias("h")).collect())
    assert cut == hashes[499] and np.searchsorted(hashes, cut) == 499
