"""Flow files, result documents and stored detectors: what goes in comes out."""

import os

import pytest
from pyspark.sql import functions as F

from flowsentry.functions.session import drop_scratch, materialise, scratch_path
from flowsentry.operators.classifiers import LinearModel
from flowsentry.plans import catalog, surrogate
from flowsentry.sources import flows, results as rs, store
from flowsentry.streaming import scoring as streams


def write_text(path, text):
    path.parent.mkdir(exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_quoted_cells_and_line_breaks(spark, tmp_path):
    write_text(tmp_path / "a" / "x.csv", 'id,note\n1,"say ""hi"", x"\n2,"two\nlines"\n3,  pad \n')
    rows = {r.id: r.note for r in flows.read_flow_strings(spark, str(tmp_path / "a"), multi_line=True).collect()}
    assert rows == {"1": 'say "hi", x', "2": "two\nlines", "3": "  pad "}


def test_written_cells_come_back(spark, tmp_path):
    cells = ['say "hi"', "  pad ", "a,b", '"', "plain", ""]
    df = spark.createDataFrame(list(enumerate(cells)), "id long, note string")
    flows.write_scored(df, str(tmp_path / "out"))
    back = {int(r.id): r.note for r in flows.read_flow_strings(spark, str(tmp_path / "out")).collect()}
    assert back == {i: c or None for i, c in enumerate(cells)}


def test_headers_are_read_without_a_job(spark, tmp_path):
    write_text(tmp_path / "h" / "a.csv", '﻿" a ","b,c"\n1,2\n')
    write_text(tmp_path / "h" / "b.csv", "b\n3\n")
    assert flows.raw_header(spark, str(tmp_path / "h" / "a.csv")) == (" a ", "b,c")
    df = flows.read_flow_strings(spark, str(tmp_path / "h"))
    assert df.columns == ["a", "b,c", "b"] and df.count() == 2


@pytest.mark.parametrize("same_header", [False, True])
def test_row_keys_follow_the_input(spark, tmp_path, same_header):
    for name, start in (("a", 0), ("b", 500), ("c", 505)):
        stop = {"a": 500, "b": 505, "c": 900}[name]
        write_text(tmp_path / "k" / f"{name}.csv", "v\n" + "".join(f"{i}\n" for i in range(start, stop)))
    keyed = flows.read_flow_strings(spark, str(tmp_path / "k"), same_header, row_key="key")
    assert [int(r.v) for r in keyed.orderBy("key").collect()] == list(range(900))
    assert sorted(r.key for r in keyed.collect()) == list(range(900))
    assert "Exchange rangepartitioning" not in keyed._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="column v"):
        flows.read_flow_strings(spark, str(tmp_path / "k"), same_header, row_key="v")


def test_documents_are_found_again_and_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([("run_2", "A", "ANN", 5), ("run_10", "A", "kNN", 6)], "run string, dataset string, model string, testing_rows long")
    for _ in range(2):
        rs.write_results(df, str(tmp_path / "r"))
    write_text(tmp_path / "r" / "A_summary.json", "{}")
    back = rs.read_documents(spark, str(tmp_path / "r"))
    assert sorted((r.run, r.model, r.testing_rows) for r in back.collect()) == [("run_10", "kNN", 6), ("run_2", "ANN", 5)]


def test_blocks_beyond_the_bound_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "MOST_BLOCKS", 1)
    for name, start in (("a", 0), ("b", 50), ("c", 70)):
        write_text(tmp_path / "k" / f"{name}.csv", "v\n" + "".join(f"{i}\n" for i in range(start, {"a": 50, "b": 70, "c": 99}[name])))
    keyed = flows.read_flow_strings(spark, str(tmp_path / "k"), row_key="key")
    assert all(int(r.v) == r.key for r in keyed.collect()) and keyed.count() == 99


def test_runs_written_one_by_one_stay(spark, tmp_path):
    frame = spark.createDataFrame([(f"run_{k}", "A", m, k) for k in (1, 2) for m in ("ANN", "kNN")],
                                  "run string, dataset string, model string, testing_rows long")
    for run in ("run_1", "run_2"):
        rs.write_results(frame.filter(F.col("run") == run), str(tmp_path / "r"))
    rs.write_results(frame.filter("run = 'run_1' and model = 'ANN'").withColumn("testing_rows", F.lit(9).cast("long")), str(tmp_path / "r"))
    back = rs.read_documents(spark, str(tmp_path / "r")).collect()
    assert sorted((r.run, r.model, r.testing_rows) for r in back) == [
        ("run_1", "ANN", 9), ("run_1", "kNN", 1), ("run_2", "ANN", 2), ("run_2", "kNN", 2)]


def test_a_stream_goes_on_past_what_it_cannot_read(spark, sf_dir, tmp_path):
    events = surrogate.events(spark, sf_dir).drop("label_rate", "label_learn").limit(40)
    detector = catalog.rule_detector(surrogate.events(spark, sf_dir))
    rows = events.filter("per_k is not null and rate < 1e9").collect()[:6]
    names = events.columns
    text = lambda r, order: ",".join(str(r[n]) for n in order)
    folder, out, aside, state = (str(tmp_path / n) for n in ("in", "out", "aside", "state"))

    def score():
        lines = streams.stream_lines(spark, folder)
        streams.score_lines(lines, names, detector, "Linear SVM", out, aside, state).awaitTermination()
        done = spark.read.schema("row_id string, Prediction string").parquet(out).collect()
        return sorted(r.row_id for r in done), {r.reason: (r.lines, r.files) for r in streams.set_aside_counts(spark, aside).collect()}

    write_text(tmp_path / "in" / "a.csv", "\n".join(["\ufeff" + ",".join(names), text(rows[0], names), "x,y", "",
                                                     text(rows[1], names).replace(str(rows[1]["hour"]), "noon", 1)]) + "\n")
    write_text(tmp_path / "in" / "b.csv", "only,two\n1,2\n3,4\n")
    first = score()
    assert first == ([str(rows[0].row_id)], {"cells": (2, 1), "header": (2, 1)})
    # The same stream goes on with a file in another order of columns.
    write_text(tmp_path / "in" / "c.csv", "\n".join([" , ".join(reversed(names)), text(rows[2], names[::-1]), text(rows[3], names[::-1])]))
    assert score() == (sorted(str(rows[k].row_id) for k in (0, 2, 3)), first[1])


def test_runs_are_ordered_by_number(spark):
    rows = [(f"run_{k}", "ANN", "A") for k in (10, 2, 1)]
    table = rs.run_order(spark.createDataFrame(rows, "run string, model string, dataset string"))
    assert [r.run for r in table.collect()] == ["run_1", "run_2", "run_10"]


def test_a_saved_detector_replaces_the_loaded_one(spark, sf_dir, tmp_path):
    detector = catalog.rule_detector(surrogate.events(spark, sf_dir))
    store.save_pipeline(spark, detector, str(tmp_path))
    before = store.load_pipeline(spark, str(tmp_path), detector.profile)
    assert store.load_pipeline(spark, str(tmp_path), detector.profile) is before
    detector.models["Linear SVM"] = LinearModel([0.0, 0.0, 0.0], 1.0, False, 0.0)
    store.save_pipeline(spark, detector, str(tmp_path))
    after = store.load_pipeline(spark, str(tmp_path), detector.profile)
    assert after.models["Linear SVM"].intercept == 1.0 != before.models["Linear SVM"].intercept


def test_scratch_tables_can_be_dropped(spark):
    materialise(spark.range(3), "to-drop")
    folder = os.path.dirname(scratch_path(spark, "x"))
    assert os.listdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)
    assert materialise(spark.range(3).select(F.col("id")), "again").count() == 3
