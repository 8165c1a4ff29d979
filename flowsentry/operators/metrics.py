"""Detection metrics from labels, predictions and scores, for several models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from flowsentry.functions.columns import col, ratio
from flowsentry.functions.session import materialise


def _per_model(
    row: DataFrame, models: list[str], fields: list[str], by: Sequence[str] = ()
) -> DataFrame:
    """Turn wide rows with columns <field>_<i> into one row per model."""
    structs = [
        F.struct(F.lit(m).alias("model"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, m in enumerate(models)
    ]
    exploded = row.select(*by, F.explode(F.array(*structs)).alias("e"))
    return exploded.select(*by, "e.model", *[F.col(f"e.{f}") for f in fields])


def confusion_counts(
    df: DataFrame, label: str, predictions: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per model (and group): tn, fp, fn, tp, testing_rows. All models in one pass.

    A null prediction counts nowhere but in testing_rows.
    """
    y = col(label) == 1
    aggregates = []
    for i, column in enumerate(predictions.values()):
        p = col(column) == 1
        aggregates += [
            F.count_if(~y & ~p).alias(f"tn_{i}"), F.count_if(~y & p).alias(f"fp_{i}"),
            F.count_if(y & ~p).alias(f"fn_{i}"), F.count_if(y & p).alias(f"tp_{i}"),
            F.count(F.lit(1)).alias(f"testing_rows_{i}"),
        ]
    return _per_model(
        df.groupBy(*by).agg(*aggregates), list(predictions),
        ["tn", "fp", "fn", "tp", "testing_rows"], by)


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Add [[TN, FP], [FN, TP]]: rows are actual classes, columns predicted ones."""
    return counts.withColumn(
        "confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    )


def metric_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(tp * 2, tp * 2 + fp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
    }


def metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, F1 and FPR; a ratio with denominator 0 is 0."""
    return counts.withColumns(metric_columns())


def ranking_metrics(
    df: DataFrame, label: str, scores: dict[str, str], by: Sequence[str] = (),
) -> DataFrame:
    """ROC AUC (ties count one half) and step-wise average precision per model and group.

    Rows are first counted by distinct score; for that each row is read once and gives a row per
    model. The counts are range-partitioned by score and written; cumulative counts run inside
    each range in parallel, and the totals of the other ranges come from one small table, so no
    window ever orders a whole column. The number of ranges follows the size of the curve.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), col(c).cast("double").alias("s")) for m, c in scores.items()]))
    group = [*by, "model"]
    counts = (
        df.select(*by, col(label).cast("long").alias("y"), pairs.alias("e"))
        .select(*by, "y", "e.model", "e.s")
        .groupBy(*group, "s")
        .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    )
    curve = materialise(
        counts.repartitionByRange(*group, "s").withColumn("b", F.spark_partition_id()), "score-curve")
    ascending = Window.partitionBy(*group, "b").orderBy("s").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)  # each score occurs once
    ranked = curve.select(
        *group, "b", "p", "q",
        F.sum("p").over(ascending).alias("cp"), F.sum("q").over(ascending).alias("cq"),
    )
    # With p0, q0 = positives and negatives in lower ranges, a score with own counts p, q
    # has q0 + cq - q negatives below it and, counted from the top, pt - p0 - cp + p
    # positives at or above it.
    totals = curve.groupBy(*group, "b").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    order = Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group, "b",
        F.coalesce(F.sum("bp").over(order), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("bq").over(order), F.lit(0)).alias("q0"),
        F.sum("bp").over(whole).alias("pt"), F.sum("bq").over(whole).alias("qt"),
    )
    # The offsets hold a row per range, model and group; Spark broadcasts them by size.
    joined = ranked.join(offsets, [*group, "b"])
    below = F.col("q0") + F.col("cq") - F.col("q")
    tp = F.col("pt") - F.col("p0") - F.col("cp") + F.col("p")
    reached = tp + F.col("qt") - below
    return joined.groupBy(*group).agg(
        (F.sum(F.col("p") * (below + F.col("q") / 2.0))
         / F.nullif(F.max("pt").cast("double") * F.max("qt"), F.lit(0.0))).alias("roc_auc"),
        F.coalesce(
            F.sum(F.col("p").cast("double") * tp / reached)
            / F.nullif(F.max("pt").cast("double"), F.lit(0.0)), F.lit(0.0)
        ).alias("average_precision"),
    )


def evaluate(
    df: DataFrame, label: str, predictions: dict[str, str], scores: dict[str, str],
    by: Sequence[str] = (),
) -> DataFrame:
    """All metrics per model and group: confusion counts, ratios, ROC AUC, average precision."""
    counted = metrics(confusion_matrix(confusion_counts(df, label, predictions, by)))
    return counted.join(ranking_metrics(df, label, scores, by), [*by, "model"])
