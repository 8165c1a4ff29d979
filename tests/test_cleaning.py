import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row, functions as F

from flowsentry.operators import cleaning
from flowsentry.plans.study import prepare
from flowsentry.profiles import (
    CICIDS2017, UNSW_NB15, FlowProfile, binarise_label, load_profile, read_feature_contract,
)
from flowsentry.sources import flows

INF = float("inf")
SMALL = FlowProfile("small", "small", ("a", "b", "service"), ("service",), preview=("service", "z"))


def test_profiles():
    assert len(CICIDS2017.features) == 65 and not CICIDS2017.categoricals
    assert len(UNSW_NB15.features) == 42 and len(UNSW_NB15.numerics) == 39
    assert load_profile("UNSW_NB15") is load_profile("UNSW-NB15") is UNSW_NB15
    with pytest.raises(KeyError):
        load_profile("other")


def test_feature_contract_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('[\n "a",\n "Flow Bytes/s"\n]')
    assert read_feature_contract(spark, str(tmp_path / "c.json")) == ("a", "Flow Bytes/s")


def test_headers_are_trimmed_and_made_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" a", "a ", "b"])
    assert cleaning.trim_headers(df).columns == ["a", "a.1", "b"]


def test_usable_rows_keep_extra_columns(spark):
    rows = [(1, 1.0, 2.0, "x", INF), (2, INF, 1.0, "x", 1.0), (3, float("nan"), 1.0, "x", 1.0),
            (4, 1.0, None, "x", 1.0), (5, 1.0, 1.0, None, 1.0), (6, -INF, 1.0, "-", 1.0), (7, 0.0, 1.0, "-", 2.0)]
    df = spark.createDataFrame(rows, "id int, ` a` double, b double, service string, extra double")
    kept = cleaning.usable_rows(df, SMALL.features).orderBy("id").collect()
    assert [(r.id, r.extra) for r in kept] == [(1, None), (7, 2.0)]


def test_missing_feature_and_case(spark):
    df = spark.createDataFrame([(1.0, 2.0)], ["A", "b"])
    with pytest.raises(cleaning.MissingFeatureError, match="'a'"):
        cleaning.require_features(df, ["a", "b"])


def test_empty_result(spark):
    df = spark.createDataFrame([(None, 1.0, "x")], "a double, b double, service string")
    with pytest.raises(cleaning.EmptyFlowsError):
        cleaning.require_nonempty(cleaning.usable_rows(df, SMALL.features))


def test_clean_training_drops_repeats(spark):
    rows = [(1.0, 1.0, 5.0, 2.0, 0), (1.0, 1.0, 5.0, 2.0, 0), (2.0, 2.0, 5.0, 1.0, 1)]
    df = spark.createDataFrame(rows, ["x", "x2", "one", "swapped", "label"])
    cleaned, kept = cleaning.clean_training(df, ["x", "x2", "one", "swapped"], "label")
    assert kept == ["x", "swapped"] and cleaned.count() == 2


def test_clean_training_keeps_one_key_a_row(spark):
    rows = [(k, float(k % 3), 7.0, float(k % 3), k % 2) for k in range(60)] + [(100, 0.0, 7.0, 0.0, 0)] * 2
    df = spark.createDataFrame(rows, "id long, x double, one double, again double, label int")
    cleaned, kept = cleaning.clean_training(df, ["x", "one", "again"], "label", "id")
    assert kept == ["x"] and cleaned.columns == ["id", "x", "label"]
    assert sorted(tuple(r) for r in cleaned.collect()) == [(k, float(k % 3), k % 2) for k in range(6)]


def test_preparation_with_cleaning(spark):
    profile = FlowProfile("t", "t", ("x", "one", "y", "kind"), ("kind",))
    rows = [(k, float(k % 40), 1.0, float(k % 7), "ab"[k % 2], int(k % 40 > 25)) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, x double, one double, y double, kind string, label int")
    preprocessor, train, test = prepare(df, profile, "id", 1, clean=True)
    assert "one" not in preprocessor.selected and {"x", "y"} <= set(preprocessor.selected)
    kept = train.join(df.select("id", "x", "y", "kind"), "id")
    assert kept.count() == train.count() == kept.select("x", "y", "kind").distinct().count()
    counts = [r["count"] for r in train.groupBy("label").count().collect()]
    assert len(set(counts)) == 1 and test.count() == 600
    assert prepare(df, profile, "id", 1)[1].count() > train.count()


def test_label_rule(spark):
    df = spark.createDataFrame([("BENIGN",), (" BENIGN ",), ("DDoS",)], ["Label"])
    assert [r.label for r in binarise_label(df, CICIDS2017).collect()] == [0, 0, 1]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_by_name_over_different_headers(spark, tmp_path):
    write(tmp_path / "1.csv", " a,b,service,Label\n1,2,http,x\n")
    write(tmp_path / "2.csv", "﻿service,b , a\n-,4,3\n")
    df = flows.read_flows(spark, str(tmp_path), SMALL)
    rows = sorted((r.a, r.b, r.service, r.Label) for r in df.collect())
    assert rows == [(1.0, 2.0, "http", "x"), (3.0, 4.0, "-", None)]


def test_csv_with_one_header(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.csv", f" a,b,service\n{i},2,http\n")
    df = flows.read_flows(spark, str(tmp_path), SMALL, same_header=True)
    assert sorted(r.a for r in df.collect()) == [0.0, 1.0, 2.0]
    write(tmp_path / "x.csv", "b, a,service\n1,2,http\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        flows.read_flows(spark, str(tmp_path), SMALL, same_header=True).collect()


def test_csv_duplicate_headers(spark, tmp_path):
    write(tmp_path / "d.csv", "a,a, a,b\n1,2,3,4\n")
    assert flows.read_flow_strings(spark, str(tmp_path)).columns == ["a", "a.1", "a.2", "b"]


def test_csv_numbers_and_null_tokens(spark, tmp_path):
    write(tmp_path / "n.csv", "a,b,service\nInfinity, 1 ,None\ninf,-Infinity,NA\nNaN,,null\nnull,2e3,-\n")
    got = flows.read_flows(spark, str(tmp_path), SMALL).collect()
    assert [r.a for r in got[:2]] == [INF, INF]
    assert got[2].a is None or math.isnan(got[2].a)
    assert [r.b for r in got] == [1.0, -INF, None, 2000.0] and got[3].a is None
    assert [r.service for r in got] == [None, None, None, "-"]


@pytest.mark.parametrize("bad", ["abc", "1d", "2F", "0x1"])
def test_bad_numbers(spark, tmp_path, bad):
    write(tmp_path / "b.csv", f"a,b,service\n1,{bad},x\n2,3,x\n")
    with pytest.raises(PySparkException):
        flows.read_flows(spark, str(tmp_path), SMALL).collect()
    lenient = flows.read_flows(spark, str(tmp_path), SMALL, strict=False)
    assert [r.b for r in lenient.orderBy("a").collect()] == [None, 3.0]
    counts = flows.bad_number_counts(flows.read_flow_strings(spark, str(tmp_path)), SMALL)
    assert {r.feature: r.bad_cells for r in counts.collect()} == {"a": 0, "b": 1}


def test_preview_records_show_nulls(spark):
    df = spark.createDataFrame([Row(a=INF, b=None, c="x"), Row(a=1.5, b=2, c=None)], "a double, b int, c string")
    records = [r.record for r in flows.preview_records(df).collect()]
    assert records == ['{"a":null,"b":null,"c":"x"}', '{"a":1.5,"b":2,"c":null}']


def test_scored_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x,y", "Attack"), (None, None, "Normal")], "a double, `b c` string, Prediction string")
    path = str(tmp_path / "out")
    flows.write_scored(df.withColumn("n", F.lit(float("nan"))), path)
    back = sorted(map(tuple, flows.read_flow_strings(spark, path).collect()), key=str)
    assert back == [("1.5", "x,y", "Attack", None), (None, None, "Normal", None)]
