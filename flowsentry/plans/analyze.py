"""Scoring a flow file end to end: read, clean, score, summarise, preview, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowsentry.functions.session import materialise
from flowsentry.operators.cleaning import require_nonempty
from flowsentry.operators.scoring import preview, summary
from flowsentry.sources.flows import read_flows, write_scored
from flowsentry.sources.store import Detector


@dataclass
class Analysis:
    """The outputs of one analysis. Of a frame they are lazy and score it anew each time they are
    used; of files they come from the scored rows, which are written once."""

    scored: DataFrame
    summary: DataFrame
    preview: DataFrame


def _analysis(scored: DataFrame, detector: Detector, choice: str) -> Analysis:
    columns = detector.prediction_columns(choice)
    return Analysis(
        scored, summary(scored, columns), preview(scored, detector.profile, list(columns.values())))


def analyze_frame(df: DataFrame, detector: Detector, choice: str) -> Analysis:
    return _analysis(detector.score(df, choice), detector, choice)


def analyze(
    spark: SparkSession, path: str, detector: Detector, choice: str, output: str | None = None,
    strict: bool = True, row_key: str | None = None,
) -> Analysis:
    """Score the CSV files under ``path``; fails if no row is usable.

    The files are read and scored once, into a scratch table that everything else reads. With
    ``row_key``, rows get a key in input order and the scored CSV keeps that order by file.
    """
    flows = read_flows(spark, path, detector.profile, strict, row_key=row_key)
    scored = materialise(detector.score(flows, choice), "analysis")
    require_nonempty(scored)
    if output:
        rows = scored if row_key is None else scored.repartitionByRange(row_key).sortWithinPartitions(row_key)
        write_scored(rows, output)
    return _analysis(scored, detector, choice)
