"""Lines of a stream are parsed once, whatever becomes of them."""

from flowsentry.plans import catalog, surrogate
from flowsentry.streaming import scoring as streams


def test_lines_are_parsed_once(spark, sf_dir, tmp_path, monkeypatch):
    """The parsed lines are written down; a column of the file may have signs that no stored column has."""
    events = surrogate.events(spark, sf_dir).drop("label_rate", "label_learn")
    detector = catalog.rule_detector(surrogate.events(spark, sf_dir))
    row = events.filter("per_k is not null and rate < 1e9").head()
    names = [*events.columns, "odd ;{}=\tname"]
    cells = [str(row[n]) for n in events.columns] + ["x"]
    folder, out, aside, state = (str(tmp_path / n) for n in ("in", "out", "aside", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(names), ",".join(cells), "x,y"]) + "\n")
    (tmp_path / "in" / "b.csv").write_text("\n".join([",".join(names[::-1]), ",".join(cells[::-1])]) + "\n")
    written, plain = [], streams.materialise
    monkeypatch.setattr(streams, "materialise", lambda df, label: written.append(label) or plain(df, label))
    streams.score_lines(streams.stream_lines(spark, folder), names, detector, "Linear SVM", out, aside, state).awaitTermination()
    assert written.count("stream-read") == 1
    assert [r.row_id for r in spark.read.parquet(out).select("row_id").collect()] == [str(row.row_id)] * 2
    assert [(r.reason, r.line) for r in spark.read.schema("reason string, line string").parquet(aside).collect()] == [("cells", "x,y")]
