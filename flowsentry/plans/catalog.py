"""Named queries over the test tables, and the SQL that must give the same rows.

Queries that fit models return what SQL can say of the result without the fit: rows, classes,
candidates, sums, and floors that are reached.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowsentry.functions.columns import (
    apply_threshold, decode_label, linear_score, narrow_float32,
)
from flowsentry.functions.session import materialise, scratch_path
from flowsentry.operators import classifiers, cleaning, features as fx, knn, metrics as mx
from flowsentry.operators import mlp, sampling, scoring, tuning
from flowsentry.plans import study, surrogate
from flowsentry.plans.analyze import analyze, analyze_frame
from flowsentry.plans.surrogate import EVENTS, EVENTS_SQL, SHIPMENTS, SHIPMENTS_SQL
from flowsentry.profiles import MODEL_ORDER, STUDY_SEEDS, FlowProfile, binarise_label
from flowsentry.sources import flows as flow_files, results as rs
from flowsentry.sources.store import Detector, load_pipeline, save_pipeline
from flowsentry.streaming import scoring as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Two fixed linear rules over the scaled value, k and hour of an event.
RULE_FEATURES = (0, 1, 2)
RULES = {
    "Logistic Regression": classifiers.LinearModel([9.0, 4.0, 0.1], -4.5, True, 0.5),
    "Linear SVM": classifiers.LinearModel([3.0, 1.0, -0.2], -1.1, False, 0.0),
}
RULE = "Linear SVM"
ALL_RULES = "Compare all models"

F_SQL = f"f as ({EVENTS_SQL})"
L_SQL = f"l as ({SHIPMENTS_SQL})"
USABLE_SQL = F_SQL + """,
u as (select * from f where isfinite(rate) and per_k is not null)"""
# The events scaled to float32 as the preprocessor does, and the two rules' scores.
SCALED_SQL = USABLE_SQL + """,
r as (select min(value::real)::double v0, max(value::real)::double v1, min(k::real)::double k0,
             max(k::real)::double k1, min(hour::real)::double h0, max(hour::real)::double h1 from u),
s as (select u.*, ((value::real::double - v0) / (v1 - v0))::real::double as x0,
             ((k::real::double - k0) / (k1 - k0))::real::double as x1,
             ((hour::real::double - h0) / (h1 - h0))::real::double as x2 from u cross join r),
z as (select s.*, 0 + x0 * 9.0::double + x1 * 4.0::double + x2 * 0.1::double + (-4.5)::double as zl,
             0 + x0 * 3.0::double + x1 * 1.0::double + x2 * (-0.2)::double + (-1.1)::double as zs from s),
p as (select z.*, 1.0::double / (1.0::double + exp(-zl)) as score_l, zs as score_s,
             (1.0::double / (1.0::double + exp(-zl)) >= 0.5)::int as label_l,
             (zs >= 0)::int as label_s from z)"""


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(column: str):
    return F.round(F.col(column), 6).alias(column)


def rule_preprocessor(df: DataFrame, profile: FlowProfile = EVENTS) -> fx.FlowPreprocessor:
    """Encoder and scaler fitted on all usable rows; the slice feeds the fixed rules."""
    usable = cleaning.usable_rows(df, profile.features)
    encoder = fx.FlowEncoder.fit(usable, profile)
    return fx.FlowPreprocessor(encoder, fx.FlowScaler.fit(usable, encoder), fx.FlowSelector(RULE_FEATURES))


def rule_detector(df: DataFrame) -> Detector:
    return Detector(EVENTS, rule_preprocessor(df), dict(RULES))


def rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable events with label_l, score_l, label_s and score_s."""
    df = surrogate.events(spark, sf_dir)
    scored = rule_preprocessor(df).transform(df)
    scored = RULES["Logistic Regression"].attach(scored, "score_l", "label_l")
    return RULES["Linear SVM"].attach(scored, "score_s", "label_s")


# ---- cleaning --------------------------------------------------------------------------

@query("usable_flows", f"""with {F_SQL}
select row_id, value, per_k, case when isfinite(rate) then rate end as rate, event_type
from f where per_k is not null""")
def usable_flows(spark, sf_dir):
    contract = [f for f in EVENTS.features if f != "rate"]
    kept = cleaning.usable_rows(surrogate.events(spark, sf_dir), contract)
    return kept.select("row_id", "value", "per_k", "rate", "event_type")


@query("contract_projection", f"""with {USABLE_SQL}
select value, k, hour, user_id, rate, per_k, event_type from u""")
def contract_projection(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    usable = cleaning.usable_rows(df, EVENTS.features)
    return cleaning.require_features(usable, EVENTS.features)


@query("infinities_to_null", f"""with {F_SQL}
select count(*) as rows, count(rate) as finite_rates, round(max(rate), 6) as largest
from (select case when isfinite(rate) then rate end as rate from f)""")
def infinities_to_null(spark, sf_dir):
    return cleaning.null_infinities(surrogate.events(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("rows"), F.count("rate").alias("finite_rates"),
        F.round(F.max("rate"), 6).alias("largest"))


@query("training_clean", """select min(event_id) as row_id, regexp_extract(props, '([0-9]+)', 1)::double as k,
       hour(ts)::double as hour, event_type, (event_type = 'error')::int as label_rate from events group by 2, 3, 4, 5""")
def training_clean(spark, sf_dir):
    df = surrogate.events(spark, sf_dir).select(
        "row_id", "k", "hour", F.lit(1.0).alias("always_one"), F.col("k").alias("k_again"), "event_type", "label_rate")
    cleaned, kept = cleaning.clean_training(
        df, ["k", "hour", "always_one", "k_again", "event_type"], "label_rate", "row_id")
    assert kept == ["k", "hour", "event_type"], kept
    return cleaned


@query("binary_labels", """select event_type, (event_type <> 'view')::int as attack, count(*) as rows
from events group by all""")
def binary_labels(spark, sf_dir):
    profile = FlowProfile("by type", "by_type", EVENTS.features, label="event_type", normal_value="view")
    labelled = binarise_label(surrogate.events(spark, sf_dir), profile, "attack")
    return labelled.groupBy("event_type", "attack").agg(F.count(F.lit(1)).alias("rows"))


# ---- files -----------------------------------------------------------------------------

def _csv_of_events(spark: SparkSession, sf_dir: str) -> str:
    """Events written as CSV with blanks round some header names."""
    path = scratch_path(spark, "events-csv")
    df = surrogate.events(spark, sf_dir).drop("label_rate", "label_learn")
    df.withColumnsRenamed({"value": " value", "hour": "hour "}).write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("csv_flow_scan", f"""with {F_SQL}
select row_id::varchar as row_id, value, k, hour, user_id, event_type, isinf(rate)::int as infinite_rate,
       per_k from f""")
def csv_flow_scan(spark, sf_dir):
    df = flow_files.read_flows(spark, _csv_of_events(spark, sf_dir), EVENTS)
    return df.select("row_id", "value", "k", "hour", "user_id", "event_type",
                     F.col("rate").isin(float("inf")).cast("int").alias("infinite_rate"), "per_k")


@query("csv_bad_numbers", f"""with {F_SQL}
select unnest(['value', 'k', 'hour']) as feature,
       unnest([0, 0, count(*) filter (where event_type = 'error')]) as bad_cells from f""")
def csv_bad_numbers(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    text = df.select(
        F.col("value").cast("string").alias("value"), F.col("k").cast("string").alias("k"),
        F.when(F.col("event_type") == "error", "12h").otherwise(F.col("hour").cast("string")).alias("hour"))
    profile = FlowProfile("text", "text", ("value", "k", "hour"))
    return flow_files.bad_number_counts(text, profile)


@query("scored_csv_sink", f"""with {SCALED_SQL}
select row_id::varchar as row_id, event_type,
       case when label_s = 1 then 'Attack' else 'Normal' end as "Prediction" from p""")
def scored_csv_sink(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    path = scratch_path(spark, "scored-csv")
    flow_files.write_scored(rule_detector(df).score(df, RULE), path)
    return flow_files.read_flow_strings(spark, path).select("row_id", "event_type", "Prediction")


# A text cell with quotes, commas, blanks and a line break per event, written and read back.
ODD_CELL_SQL = """concat('  "', event_type, '", ', row_id, chr(10), 'next  ')"""


def _odd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.lit('  "'), "event_type", F.lit('", '), F.col("row_id").cast("string"), F.lit("\nnext  "))
    return surrogate.events(spark, sf_dir).select("row_id", "value", cell.alias("note"))


@query("csv_quoted_cells", f"""with {F_SQL} select row_id::varchar as row_id, {ODD_CELL_SQL} as note from f""")
def csv_quoted_cells(spark, sf_dir):
    path = scratch_path(spark, "quoted-csv")
    flow_files.write_scored(_odd_cells(spark, sf_dir), path)
    return flow_files.read_flow_strings(spark, path, multi_line=True).select("row_id", "note")


@query("scored_csv_quotes", f"""with {SCALED_SQL}
select row_id::varchar as row_id, replace({ODD_CELL_SQL}, chr(10), '|') as note,
       case when label_s = 1 then 'Attack' else 'Normal' end as "Prediction" from p""")
def scored_csv_quotes(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    noted = df.join(_odd_cells(spark, sf_dir).select("row_id", F.replace("note", F.lit("\n"), F.lit("|")).alias("note")), "row_id")
    path = scratch_path(spark, "scored-quotes")
    flow_files.write_scored(rule_detector(df).score(noted, RULE), path)
    return flow_files.read_flow_strings(spark, path).select("row_id", "note", "Prediction")


@query("csv_row_keys", f"""with {F_SQL} select row_id::varchar as row_id, row_number() over (order by row_id) - 1 as place from f""")
def csv_row_keys(spark, sf_dir):
    """Rows written in the order of their id over several files get keys in that order."""
    path = scratch_path(spark, "keyed-csv")
    df = surrogate.events(spark, sf_dir).select("row_id", "value")
    df.repartitionByRange(3, "row_id").sortWithinPartitions("row_id").write.csv(path, header=True)
    keyed = flow_files.read_flow_strings(spark, path, row_key="key")
    return keyed.select("row_id", F.col("key").alias("place"))


@query("analyze_file", f"""with {SCALED_SQL}
select 'Linear SVM' as model, count(*) as rows, (count(*) - sum(label_s))::bigint as normal, sum(label_s)::bigint as attack,
       round_even(sum(label_s)::double / count(*) * 100, 2) as attack_rate from p""")
def analyze_file(spark, sf_dir):
    detector = rule_detector(surrogate.events(spark, sf_dir))
    return analyze(spark, _csv_of_events(spark, sf_dir), detector, RULE).summary


# ---- encoding, scaling, selection ------------------------------------------------------

@query("one_hot_encoding", f"""with {F_SQL}
select row_id, value, (event_type = 'click')::int as "event_type_click",
       (event_type = 'error')::int as "event_type_error", (event_type = 'purchase')::int as "event_type_purchase",
       (event_type = 'signup')::int as "event_type_signup", (event_type = 'view')::int as "event_type_view" from f""")
def one_hot_encoding(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    profile = FlowProfile("typed", "typed", ("value", "event_type"), ("event_type",))
    encoded = fx.FlowEncoder.fit(df, profile).expressions()
    hot = [c.cast("int").alias(n) for n, c in encoded.items() if n != "value"]
    return df.select("row_id", "value", *hot)


@query("unseen_levels", """select 'event_type' as feature, count(*) filter (where event_type not in
    (select event_type from events group by event_type having min(value) > (select min(value) from events))) as unseen_rows
from events""")
def unseen_levels(spark, sf_dir):
    """Levels are learnt from the event types that never reach the lowest value."""
    df = surrogate.events(spark, sf_dir)
    lowest = df.agg(F.min("value")).head()[0]
    by_type = df.groupBy("event_type").agg(F.min("value").alias("low"))
    known = by_type.filter(F.col("low") > lowest).select("event_type")
    profile = FlowProfile("typed", "typed", ("event_type",), ("event_type",))
    return fx.FlowEncoder.fit(known, profile).unseen_counts(df)


@query("min_max_scaling", f"""with {L_SQL}, q as (select row_key, l_quantity::real::double a,
  l_extendedprice::real::double b, l_discount::real::double c, l_tax::real::double d from l),
m as (select min(a) a0, max(a) a1, min(b) b0, max(b) b1, min(c) c0, max(c) c1, min(d) d0, max(d) d1 from q)
select row_key, round((a - a0) / (a1 - a0), 6) as l_quantity, round((b - b0) / (b1 - b0), 6) as l_extendedprice,
       round((c - c0) / (c1 - c0), 6) as l_discount, round((d - d0) / (d1 - d0), 6) as l_tax
from q cross join m""")
def min_max_scaling(spark, sf_dir):
    df = surrogate.shipments(spark, sf_dir)
    encoder = fx.FlowEncoder(SHIPMENTS.numerics)
    scaled = fx.scaled_columns(encoder, fx.FlowScaler.fit(df, encoder))
    return df.select("row_key", *[F.round(c, 6).alias(n) for n, c in scaled.items()])


@query("float32_narrowing", f"""with {L_SQL}
select row_key, l_extendedprice::real::double as narrowed,
       round((l_extendedprice - l_extendedprice::real::double) * 1000, 4) as lost from l""")
def float32_narrowing(spark, sf_dir):
    narrowed = narrow_float32(F.col("l_extendedprice")).cast("double")
    return surrogate.shipments(spark, sf_dir).select(
        "row_key", narrowed.alias("narrowed"),
        F.round((F.col("l_extendedprice") - narrowed) * 1000, 4).alias("lost"))


@query("feature_matrix", f"""with {SCALED_SQL}
select row_id, round(x0, 6) as x0, round(x1, 6) as x1, round(x2, 6) as x2 from s""")
def feature_matrix(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    x = rule_preprocessor(df).transform(df)
    return x.select("row_id", *[F.round(F.col("features")[i].cast("double"), 6).alias(f"x{i}") for i in range(3)])


def _anova_sql(source: str, label: str, columns: dict[str, str], by: str = "") -> str:
    """ANOVA F of several columns of a relation, by plain group statistics."""
    extra, tail = (f"{by},", f"group by {by}") if by else ("", "")
    joins = f"using ({by})" if by else "on true"
    parts = [f"""select '{name}' as feature, {extra} df1_between / nullif(within_df2, 0) as f_score from (
  select {extra} sum(n * (m - gm) * (m - gm)) / (count(*) - 1) as df1_between,
         sum((n - 1) * v) / (sum(n) - count(*)) as within_df2
  from (select {extra} {label} as y, count(*) n, avg({x}) m, var_samp({x}) v from {source} group by {extra} y)
  join (select {extra} avg({x}) gm from {source} {tail}) {joins} {tail})""" for name, x in columns.items()]
    return " union all ".join(parts)


RAW_COLUMNS = {c: c for c in ("value", "k", "hour", "user_id", "per_k")}


@query("anova_f_scores", f"""with {USABLE_SQL}
select feature, round(f_score, 4) as f_score from ({_anova_sql('u', 'label_learn', RAW_COLUMNS)})""")
def anova_f_scores(spark, sf_dir):
    usable = cleaning.usable_rows(surrogate.events(spark, sf_dir), EVENTS.features)
    scores = fx.anova_f_scores(usable, {c: F.col(c) for c in RAW_COLUMNS}, "label_learn")
    return scores.select("feature", F.round("f_score", 4).alias("f_score"))


@query("top_features", f"""with {USABLE_SQL}
select feature, round(f_score, 4) as f_score
from ({_anova_sql('u', 'label_learn', RAW_COLUMNS)}) order by f_score desc, feature limit 3""")
def top_features(spark, sf_dir):
    usable = cleaning.usable_rows(surrogate.events(spark, sf_dir), EVENTS.features)
    scores = fx.anova_f_scores(usable, {c: F.col(c) for c in RAW_COLUMNS}, "label_learn")
    return fx.top_features(scores, 3).select("feature", F.round("f_score", 4).alias("f_score"))


@query("mutual_information", f"""with {SCALED_SQL},
b as (select 'value' as feature, label_learn as y, least(15, floor(((value::real::double - v0) / (v1 - v0)) * 16)) as b from u cross join r
  union all select 'k', label_learn, least(15, floor(((k::real::double - k0) / (k1 - k0)) * 16)) from u cross join r
  union all select 'hour', label_learn, least(15, floor(((hour::real::double - h0) / (h1 - h0)) * 16)) from u cross join r),
c as (select feature, b, y, count(*) n from b group by all),
t as (select *, sum(n) over (partition by feature, b) nb, sum(n) over (partition by feature, y) ny,
             sum(n) over (partition by feature) nt from c)
select feature, round(sum(n / nt * ln(n * nt / (nb * ny))), 6) as mi_score from t group by feature""")
def mutual_information(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    usable = cleaning.usable_rows(df, EVENTS.features)
    encoder = fx.FlowEncoder(("value", "k", "hour"))
    scaled = fx.scaled_columns(encoder, fx.FlowScaler.fit(usable, encoder))
    scores = fx.mutual_information_scores(usable, scaled, "label_learn")
    return scores.select("feature", r6("mi_score"))


# Importances are shares: one per encoded column, none below 0, 1 in all. The label depends on value
# most, so that is one of the two that lead.
@query("forest_importance_scores", f"""with {USABLE_SQL}
select 6 + count(distinct event_type) as columns, 1.0::double as total, true as value_leads from u""")
def forest_importance_scores(spark, sf_dir):
    usable = cleaning.usable_rows(surrogate.events(spark, sf_dir), EVENTS.features)
    encoder = fx.FlowEncoder.fit(usable, EVENTS)
    scaled = fx.scaled_columns(encoder, fx.FlowScaler.fit(usable, encoder))
    return _importance_facts(fx.forest_scores(usable, scaled, "label_learn"))


def _importance_facts(scores: DataFrame) -> DataFrame:
    name, value = scores.columns[:2]
    leading = scores.orderBy(F.col(value).desc(), name).limit(2).agg(
        F.array_contains(F.collect_list(name), "value").alias("value_leads"))
    return scores.agg(
        F.count_if(F.col(value) >= 0).alias("columns"), F.round(F.sum(value), 6).alias("total")).crossJoin(leading)


# ---- sampling --------------------------------------------------------------------------

def _ranked_sql(source: str, label: str, key: str, prefix: str) -> str:
    return (f"select *, row_number() over (partition by {label} order by md5(concat('{prefix}', {key}::varchar))) as rank, "
            f"count(*) over (partition by {label}) as size from {source}")


def _share_sql(source: str, label: str) -> str:
    """Training rows per class of a 70 % split: test rows rounded up, largest remainders first."""
    return f"""h as (select {label}, base + (row_number() over (order by rest desc, {label}) <= t - sum(base) over ())::int as share
  from (select {label}, size * t // n as base, size * t % n as rest, t from (
    select {label}, count(*) as size, (sum(count(*)) over ())::bigint as n, (sum(count(*)) over () * 7 // 10)::bigint as t
    from {source} group by {label})))"""


@query("stratified_split", f"""with {F_SQL}, {_share_sql('f', 'label_learn')}, k as ({_ranked_sql('f', 'label_learn', 'row_id', '42-')})
select row_id, label_learn, case when rank <= share then 'train' else 'test' end as part from k join h using (label_learn)""")
def stratified_split(spark, sf_dir):
    df = surrogate.events(spark, sf_dir).select("row_id", "label_learn")
    train, test = sampling.stratified_split(df, "row_id", "label_learn")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("undersampled_train", f"""with {L_SQL}, k as ({_ranked_sql('l', 'label', 'row_key', '42-balance-')}),
m as (select min(size) as n from k)
select row_key, label from k cross join m where rank <= n""")
def undersampled_train(spark, sf_dir):
    df = surrogate.shipments(spark, sf_dir).select("row_key", "label")
    return sampling.undersample(df, "row_key", "label")


@query("tuning_subsample", f"""with {L_SQL}, k as ({_ranked_sql('l', 'label', 'row_key', '42-tune-')}),
t as (select label, count(*) as size from l group by label), n as (select sum(size) as total from t),
w as (select label, floor(2000 * size / total) as base, (2000 * size) % total as rest from t cross join n),
x as (select label, base + (row_number() over (order by rest desc, label) <= 2000 - sum(base) over ())::int as share from w)
select row_key, label from k join x using (label) where rank <= share""")
def tuning_subsample(spark, sf_dir):
    df = surrogate.shipments(spark, sf_dir).select("row_key", "label")
    return sampling.subsample(df, 2000, "row_key", "label")


@query("stratified_folds", f"""with {L_SQL}, k as ({_ranked_sql('l', 'label', 'row_key', '42-fold-')})
select row_key, label, case when rank <= size // 3 then 0 when rank <= size * 2 // 3 then 1 else 2 end as fold from k""")
def stratified_folds(spark, sf_dir):
    df = surrogate.shipments(spark, sf_dir).select("row_key", "label")
    return sampling.assign_folds(df, "row_key", "label")


# ---- scoring and summaries -------------------------------------------------------------

@query("linear_scores", f"""with {SCALED_SQL}
select row_id, round(score_s, 6) as score, label_s as label,
       case when label_s = 1 then 'Attack' else 'Normal' end as decoded from p""")
def linear_scores(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    x = rule_preprocessor(df).transform(df)
    rule = RULES[RULE]
    scored = x.withColumn("score", linear_score(F.col("features"), rule.weights, rule.intercept))
    labelled = scored.withColumn("label", apply_threshold(F.col("score"), rule.threshold))
    return labelled.select("row_id", r6("score"), "label", decode_label(F.col("label")).alias("decoded"))


SUMMARY_SQL = f"""with {SCALED_SQL},
c as (select 'Logistic Regression' as model, count(*) as rows, sum(label_l)::bigint as attack from p
  union all select 'Linear SVM', count(*), sum(label_s)::bigint from p)
"""


@query("attack_summary", SUMMARY_SQL + """select model, rows, rows - attack as normal, attack,
       round_even(attack::double / rows * 100, 2) as attack_rate from c""")
def attack_summary(spark, sf_dir):
    """How many usable flows are attacks, by model."""
    df = surrogate.events(spark, sf_dir)
    detector = rule_detector(df)
    return analyze_frame(df, detector, ALL_RULES).summary


@query("class_shares", SUMMARY_SQL + """select model, round((rows - attack)::double / rows * 100, 1) as normal_share,
       round(attack::double / rows * 100, 1) as attack_share from c""")
def class_shares(spark, sf_dir):
    return scoring.class_shares(attack_summary(spark, sf_dir))


@query("flow_predictions", f"""with {SCALED_SQL}
select row_id, case when label_l = 1 then 'Attack' else 'Normal' end as "Prediction_Logistic_Regression",
       case when label_s = 1 then 'Attack' else 'Normal' end as "Prediction_Linear_SVM" from p""")
def flow_predictions(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    return rule_detector(df).score(df, ALL_RULES).select(
        "row_id", "Prediction_Logistic_Regression", "Prediction_Linear_SVM")


@query("flow_preview", f"""with {SCALED_SQL}
select case when label_s = 1 then 'Attack' else 'Normal' end as "Prediction", event_type, value, hour from p""")
def flow_preview(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    return analyze_frame(df, rule_detector(df), RULE).preview


@query("preview_records", f"""with {F_SQL}
select concat('{{"row_id":', row_id, ',"event_type":"', event_type, '","rate":',
       case when isfinite(rate) then '1' else 'null' end, '}}') as record from f""")
def preview_records(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    shown = F.when(F.col("rate") == float("inf"), F.col("rate")).otherwise(F.lit(1.0))
    records = flow_files.preview_records(df.select("row_id", "event_type", shown.alias("rate")))
    return records.select(F.replace("record", F.lit(":1.0}"), F.lit(":1}")).alias("record"))


# ---- metrics ---------------------------------------------------------------------------

CONFUSION_SQL = f"""with {SCALED_SQL},
q as (select 'Logistic Regression' as model, label_learn as y, label_l as p, score_l as s from p
  union all select 'Linear SVM', label_learn, label_s, score_s from p),
c as (select model, count(*) filter (where y = 0 and p = 0) as tn, count(*) filter (where y = 0 and p = 1) as fp,
  count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 1 and p = 1) as tp,
  count(*) as testing_rows from q group by model)
"""
LABELS = {"Logistic Regression": "label_l", "Linear SVM": "label_s"}
SCORES = {"Logistic Regression": "score_l", "Linear SVM": "score_s"}


@query("confusion_matrix", CONFUSION_SQL + """select model, tn, fp, fn, tp, testing_rows,
  concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') as matrix from c""")
def confusion_matrix(spark, sf_dir):
    counts = mx.confusion_matrix(mx.confusion_counts(rule_scored(spark, sf_dir), "label_learn", LABELS))
    return counts.withColumn("matrix", F.to_json("confusion_matrix")).drop("confusion_matrix")


@query("detection_metrics", CONFUSION_SQL + """select model, testing_rows,
  round((tp + tn) / (tn + fp + fn + tp), 6) as accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1_score,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as false_positive_rate from c""")
def detection_metrics(spark, sf_dir):
    scored = mx.metrics(mx.confusion_counts(rule_scored(spark, sf_dir), "label_learn", LABELS))
    return scored.select("model", "testing_rows", r6("accuracy"), r6("precision"), r6("recall"),
                         r6("f1_score"), r6("false_positive_rate"))


RANKING_SQL = """g as (select model, s, sum(y) as p, count(*) - sum(y) as q from q group by model, s),
w as (select *, sum(q) over (partition by model order by s) - q as below,
  sum(p) over (partition by model order by s desc) as tp, sum(p + q) over (partition by model order by s desc) as n,
  sum(p) over (partition by model) as pt, sum(q) over (partition by model) as qt from g)
select model, round(sum(p * (below + q / 2.0::double)) / (max(pt)::double * max(qt)), 6) as roc_auc,
  round(sum(p::double * tp / n) / max(pt), 6) as average_precision from w group by model"""


@query("ranking_metrics", CONFUSION_SQL + ", " + RANKING_SQL)
def ranking_metrics(spark, sf_dir):
    ranked = mx.ranking_metrics(rule_scored(spark, sf_dir), "label_learn", SCORES)
    return ranked.select("model", r6("roc_auc"), r6("average_precision"))


@query("ranking_metrics_tied", f"""with {F_SQL},
q as (select 'value' as model, label_learn as y, round(value / 10) as s from f
  union all select 'k', label_learn, k from f), {RANKING_SQL}""")
def ranking_metrics_tied(spark, sf_dir):
    df = surrogate.events(spark, sf_dir).withColumn("s", F.round(F.col("value") / 10))
    ranked = mx.ranking_metrics(df, "label_learn", {"value": "s", "k": "k"})
    return ranked.select("model", r6("roc_auc"), r6("average_precision"))


# ---- repeated study --------------------------------------------------------------------

_SEEDS_SQL = "values " + ", ".join(f"('run_{i}', {s})" for i, s in enumerate(STUDY_SEEDS, 1))
# Per run: the events' test part, scored by the two rules; metrics of each.
RUNS_SQL = f"""with {SCALED_SQL}, seeds(run, seed) as ({_SEEDS_SQL}), {_share_sql('p', 'label_learn')},
k as (select run, seed, p.*, row_number() over (partition by run, label_learn order by md5(concat(seed, '-', row_id))) as rank
        from p cross join seeds),
t as (select * from k join h using (label_learn) where rank > share),
q as (select run, seed, 'Logistic Regression' as model, label_learn as y, label_l as p, score_l as s from t
  union all select run, seed, 'Linear SVM', label_learn, label_s, score_s from t),
c as (select run, seed, model, count(*) filter (where y = 0 and p = 0) as tn, count(*) filter (where y = 0 and p = 1) as fp,
  count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 1 and p = 1) as tp, count(*) as testing_rows
  from q group by run, seed, model),
g as (select run, model, s, sum(y) as p, count(*) - sum(y) as q from q group by run, model, s),
w as (select *, sum(q) over (partition by run, model order by s) - q as below,
  sum(p) over (partition by run, model order by s desc) as tp, sum(p + q) over (partition by run, model order by s desc) as n,
  sum(p) over (partition by run, model) as pt, sum(q) over (partition by run, model) as qt from g),
a as (select run, model, sum(p * (below + q / 2.0::double)) / (max(pt)::double * max(qt)) as roc_auc,
  sum(p::double * tp / n) / max(pt) as average_precision from w group by run, model),
runs as (select run, seed, 'events' as dataset, model, (tp + tn) / testing_rows as accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_score, roc_auc, average_precision,
  coalesce(fp / nullif(fp + tn, 0), 0) as false_positive_rate, testing_rows, tn, fp, fn, tp
  from c join a using (run, model))
"""


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of the two rules on the test part of each seed's split."""
    scored = materialise(
        rule_scored(spark, sf_dir).select("row_id", "label_learn", "label_l", "label_s", "score_l", "score_s"),
        "rule-scores")
    parts = None
    for number, seed in enumerate(STUDY_SEEDS, start=1):
        _, test = sampling.stratified_split(scored, "row_id", "label_learn", seed=seed)
        marked = test.withColumn("run", F.lit(f"run_{number}"))
        parts = marked if parts is None else parts.unionByName(marked)
    return mx.evaluate(parts, "label_learn", LABELS, SCORES, by=["run"]).select(
        "run", F.lit("events").alias("dataset"), "model", "testing_rows",
        F.struct(*rs.METRICS).alias("metrics"), "confusion_matrix",
        F.lit(0.5).alias("training_seconds"), F.lit(0.25).alias("prediction_seconds"))


@query("run_table", RUNS_SQL + "select run, seed, dataset, model, "
       + ", ".join(f"round({m}, 6) as {m}" for m in rs.METRICS)
       + ", 0.5::double as training_seconds, 0.25::double as prediction_seconds, testing_rows from runs")
def run_table(spark, sf_dir):
    """Documents written as JSON, read back as a tree and flattened."""
    path = scratch_path(spark, "documents")
    rs.write_results(rule_documents(spark, sf_dir), path)
    table = rs.read_results(spark, path)
    return table.withColumns({m: F.round(m, 6) for m in rs.METRICS})


@query("documents_by_run", RUNS_SQL + """select run, model, count(*) as documents, (case when run = 'run_1' then 0.75 else 0.5 end)::double
       as training_seconds from runs group by run, model""")
def documents_by_run(spark, sf_dir):
    """Runs written one by one stay beside each other; the first one, written again, replaces itself."""
    path = scratch_path(spark, "documents-by-run")
    documents = materialise(rule_documents(spark, sf_dir), "documents")
    for run in sorted(r.run for r in documents.select("run").distinct().collect()):  # five at most
        rs.write_results(documents.filter(F.col("run") == run), path)
    again = documents.filter("run = 'run_1'").withColumn("training_seconds", F.lit(0.75))
    rs.write_results(again, path)
    table = rs.read_results(spark, path)
    return table.groupBy("run", "model").agg(F.count(F.lit(1)).alias("documents"), F.max("training_seconds").alias("training_seconds"))


@query("run_statistics", RUNS_SQL + "select dataset, model, count(*) as runs, "
       + ", ".join(f"round(avg({m}), 6) as {m}_mean, round(stddev_samp({m}), 6) as {m}_std" for m in rs.METRICS)
       + " from runs group by dataset, model")
def run_statistics(spark, sf_dir):
    table = rs.run_table(rule_documents(spark, sf_dir))
    found = study.run_statistics(table, rs.METRICS)
    return found.select("dataset", "model", "runs", *[r6(f"{m}_{s}") for m in rs.METRICS for s in ("mean", "std")])


@query("result_summaries", RUNS_SQL + """select run, model, 'events' as datasets, testing_rows,
  concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') as matrix from runs""")
def result_summaries(spark, sf_dir):
    summaries = rs.summarise_results(rule_documents(spark, sf_dir))
    path = scratch_path(spark, "summaries")
    rs.write_summaries(summaries, path)
    ddl = "map<string, struct<testing_rows: bigint, confusion_matrix: array<array<bigint>>>>"
    back = spark.read.text(path).withColumn("d", F.from_json("value", ddl))
    document = F.col("d")["events"]
    return back.select("run", "model", F.array_join(F.map_keys("d"), ",").alias("datasets"),
                       document["testing_rows"].alias("testing_rows"),
                       F.to_json(document["confusion_matrix"]).alias("matrix"))


@query("study_tables_csv", RUNS_SQL + "select dataset, model, round(avg(f1_score), 6) as f1_score_mean, "
       "round(stddev_samp(f1_score), 6) as f1_score_std, sum(testing_rows)::bigint as testing_rows from runs group by dataset, model")
def study_tables_csv(spark, sf_dir):
    runs = materialise(rs.run_table(rule_documents(spark, sf_dir)), "runs")
    path = scratch_path(spark, "study")
    rs.write_tables(runs, study.run_statistics(runs), path)
    statistics = spark.read.csv(f"{path}/mean_std_metrics", header=True).select(
        "dataset", "model", F.round(F.col("f1_score_mean").cast("double"), 6).alias("f1_score_mean"),
        F.round(F.col("f1_score_std").cast("double"), 6).alias("f1_score_std"))
    rows = spark.read.csv(f"{path}/per_run_metrics", header=True).groupBy("dataset", "model").agg(
        F.sum(F.col("testing_rows").cast("bigint")).alias("testing_rows"))
    return statistics.join(rows, ["dataset", "model"])


# Candidate thresholds on the SVM rule's score, scored by F1 over three folds.
THRESHOLDS = (-0.4, -0.2, 0.0, 0.2, 0.4)
CANDIDATES_SQL = f"""with {SCALED_SQL}, k as ({_ranked_sql('p', 'label_learn', 'row_id', '42-fold-')}),
d as (select label_learn as y, score_s as s, case when rank <= size // 3 then 0 when rank <= size * 2 // 3 then 1 else 2 end as fold from k),
h(candidate, threshold) as (values {", ".join(f"({i}, {t}::double)" for i, t in enumerate(THRESHOLDS))}),
m as (select candidate, threshold, fold, count(*) filter (where y = 1 and s >= threshold) as tp,
  count(*) filter (where y = 0 and s >= threshold) as fp, count(*) filter (where y = 1 and s < threshold) as fn
  from d cross join h group by all),
o as (select candidate, threshold, avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) as mean_f1_score from m group by all)
"""


def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = sampling.assign_folds(rule_scored(spark, sf_dir), "row_id", "label_learn")
    y = F.col("label_learn") == 1
    counts = folded.groupBy("fold").agg(*[
        e for i, t in enumerate(THRESHOLDS) for e in (
            F.count_if(~y & (F.col("score_s") < t)).alias(f"tn_{i}"),
            F.count_if(~y & (F.col("score_s") >= t)).alias(f"fp_{i}"),
            F.count_if(y & (F.col("score_s") < t)).alias(f"fn_{i}"),
            F.count_if(y & (F.col("score_s") >= t)).alias(f"tp_{i}"))])
    exploded = counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.lit(t).alias("threshold"),
                 *[F.col(f"{c}_{i}").alias(c) for c in ("tn", "fp", "fn", "tp")])
        for i, t in enumerate(THRESHOLDS)])).alias("e")).select("e.*")
    scored = mx.metrics(exploded)
    return scored.groupBy("candidate", F.col("threshold").cast("string").alias("parameters")).agg(
        F.avg("f1_score").alias("mean_f1_score"))


@query("mean_fold_scores", CANDIDATES_SQL
       + "select candidate, threshold::varchar as parameters, round(mean_f1_score, 6) as mean_f1_score from o")
def mean_fold_scores(spark, sf_dir):
    return threshold_scores(spark, sf_dir).select("candidate", "parameters", r6("mean_f1_score"))


@query("best_candidate", CANDIDATES_SQL + """select candidate, threshold::varchar as parameters,
  round(mean_f1_score, 6) as mean_f1_score from o order by mean_f1_score desc, candidate limit 1""")
def best_candidate(spark, sf_dir):
    return tuning.select_best(threshold_scores(spark, sf_dir)).select(
        "candidate", "parameters", r6("mean_f1_score"))


STABILITY_SQL = f"""with {USABLE_SQL}, {_share_sql('u', 'label_learn')}, seeds(seed) as (values {", ".join(f"({s})" for s in STUDY_SEEDS)}),
k as (select seed, u.*, row_number() over (partition by seed, label_learn order by md5(concat(seed, '-', row_id))) as rank
        from u cross join seeds),
t as (select * from k join h using (label_learn) where rank <= share),
o as ({_anova_sql('t', 'label_learn', RAW_COLUMNS, 'seed')}),
g as (select *, row_number() over (partition by seed order by f_score desc, feature) as place from o)
select 'events' as dataset, feature, count(*) as times_selected, round(avg(f_score), 3) as mean_importance
from g where place <= 3 group by feature"""


@query("selection_stability", STABILITY_SQL)
def selection_stability(spark, sf_dir):
    usable = materialise(
        cleaning.usable_rows(surrogate.events(spark, sf_dir), EVENTS.features)
        .select("row_id", "label_learn", *RAW_COLUMNS), "usable")
    documents = None
    for seed in STUDY_SEEDS:
        train, _ = sampling.stratified_split(usable, "row_id", "label_learn", seed=seed)
        best = fx.top_features(fx.anova_f_scores(train, {c: F.col(c) for c in RAW_COLUMNS}, "label_learn"), 3)
        pairs = F.collect_list(F.struct("feature", F.col("f_score").alias("importance")))  # three rows
        row = best.agg(pairs.alias("feature_importances")).withColumn("dataset", F.lit("events"))
        documents = row if documents is None else documents.unionByName(row)
    return study.selection_stability(documents).withColumn(
        "mean_importance", F.round("mean_importance", 3))


# ---- nearest neighbours ----------------------------------------------------------------

KNN_SQL = f"""with {SCALED_SQL}, {_share_sql('s', 'label_learn')}, k as (
  select * from ({_ranked_sql('s', 'label_learn', 'row_id', '42-')}) join h using (label_learn)),
a as (select row_id as id, label_learn as label, x0, x1, x2 from k where rank <= share),
b as (select row_id as qid, x0, x1, x2 from k where rank > share),
d as (select qid, id, label, (b.x0 - a.x0) * (b.x0 - a.x0) + (b.x1 - a.x1) * (b.x1 - a.x1) + (b.x2 - a.x2) * (b.x2 - a.x2) as d2
  from b cross join a),
n as (select *, row_number() over (partition by qid order by d2, id) as rank from d qualify rank <= 15)
"""


def _knn_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = surrogate.events(spark, sf_dir)
    rows = rule_preprocessor(df).transform(df).select(
        "row_id", F.col("label_learn").alias("label"), "features")
    return sampling.stratified_split(materialise(rows, "rows", spread=True), "row_id", "label")


@query("knn_neighbours", KNN_SQL + "select qid, rank::int as rank, id, round(sqrt(d2), 6) as distance, label from n where rank <= 5")
def knn_neighbours(spark, sf_dir):
    train, test = _knn_parts(spark, sf_dir)
    return knn.knn_topk(train, test, "row_id", 5).select("qid", "rank", "id", r6("distance"), "label")


def _vote_sql(k: int, weights: str) -> str:
    if weights == "uniform":
        return f"select qid, avg(label) as share from n where rank <= {k} group by qid"
    return f"""select qid, case when count(*) filter (where d2 = 0) > 0 then avg(label) filter (where d2 = 0)
  else sum(label / nullif(sqrt(d2), 0)) / sum(1 / nullif(sqrt(d2), 0)) end as share from n where rank <= {k} group by qid"""


for _k, _w in ((5, "uniform"), (15, "distance")):
    def _knn_vote(spark, sf_dir, k=_k, w=_w):
        train, test = _knn_parts(spark, sf_dir)
        return knn.knn_predict(train, test, "row_id", k, w).select("qid", r6("share"), "prediction")

    query(f"knn_vote_{_w}", KNN_SQL + f"select qid, round(share, 6) as share, (share > 0.5)::int as prediction "
          f"from ({_vote_sql(_k, _w)})")(_knn_vote)


def _knn_grid_sql() -> str:
    votes = " union all ".join(
        f"select fold, {i} as candidate, {k} as n_neighbors, '{w}' as weights, y, (share > 0.5)::int as p from "
        f"(select * from ({_vote_sql(k, w)}) join e using (qid))"
        for i, (k, w) in enumerate((k, w) for k in knn.NEIGHBOURS for w in knn.WEIGHTS))
    return f"""with {SCALED_SQL}, k as ({_ranked_sql('s', 'label_learn', 'row_id', '42-fold-')}),
e as (select row_id as qid, label_learn as y, x0, x1, x2, case when rank <= size // 3 then 0 when rank <= size * 2 // 3 then 1 else 2 end as fold from k),
d as (select b.qid, a.qid as id, a.y as label, (b.x0 - a.x0) * (b.x0 - a.x0) + (b.x1 - a.x1) * (b.x1 - a.x1) + (b.x2 - a.x2) * (b.x2 - a.x2) as d2
  from e b join e a on a.fold <> b.fold),
n as (select *, row_number() over (partition by qid order by d2, id) as rank from d qualify rank <= {max(knn.NEIGHBOURS)}),
v as ({votes}),
c as (select fold, candidate, n_neighbors, weights, count(*) filter (where y = 0 and p = 1) as fp,
  count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 1 and p = 1) as tp from v group by all)
select fold, candidate, n_neighbors, weights, round(2 * tp / (2 * tp + fp + fn), 6) as f1_score from c"""


@query("knn_grid", _knn_grid_sql())
def knn_grid(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    rows = rule_preprocessor(df).transform(df).select("row_id", F.col("label_learn").alias("label"), "features")
    folded = materialise(sampling.assign_folds(rows, "row_id", "label"), "folds", spread=True)
    return tuning.knn_grid(folded, "row_id").withColumn(
        "f1_score", F.round("f1_score", 6))


@query("embedding_neighbours", f"""with e as (select vec_id, label, embedding as v from embeddings),
{_share_sql('e', 'label')}, k as (select * from ({_ranked_sql('e', 'label', 'vec_id', '42-')}) join h using (label)),
a as (select vec_id as id, v from k where rank <= share),
b as (select vec_id as qid, v from k where rank > share),
d as (select qid, id, list_distance(b.v::double[], a.v::double[]) as d
  from b cross join a)
select qid, rank::int as rank, round(d, 5) as distance
from (select *, row_number() over (partition by qid order by d, id) as rank from d qualify rank <= 3)""")
def embedding_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "label", F.col("embedding").alias("features"))
    train, test = sampling.stratified_split(rows, "vec_id", "label")
    found = knn.knn_topk(train, test, "vec_id", 3)
    return found.select("qid", "rank", F.round("distance", 5).alias("distance"))


# ---- fitted models ---------------------------------------------------------------------

def _prepared(spark: SparkSession, sf_dir: str):
    return study.prepare(surrogate.events(spark, sf_dir), EVENTS, "row_id")


def _evaluated(model, test: DataFrame, name: str) -> DataFrame:
    scored = materialise(model.attach(test, "score", "prediction").select("label", "score", "prediction"), "scored")
    return mx.evaluate(scored, "label", {name: "prediction"}, {name: "score"}).drop("confusion_matrix")


# A fit's own numbers are not SQL's to give. What SQL knows are the test rows and their classes, which
# the confusion cells must add up to, and that the learnable label is learnt to a floor.
TEST_SQL = f"""with {USABLE_SQL}, {_share_sql('u', 'label_learn')},
k as ({_ranked_sql('u', 'label_learn', 'row_id', '42-')}),
t as (select * from k join h using (label_learn) where rank > share)
"""


def _facts(evaluated: DataFrame, floor: float) -> DataFrame:
    return evaluated.select(
        "model", "testing_rows", (F.col("tn") + F.col("fp")).alias("normal_rows"),
        (F.col("fn") + F.col("tp")).alias("attack_rows"), (F.col("f1_score") >= floor).alias("f1_reached"),
        (F.col("roc_auc") >= floor).alias("auc_reached"))


def _facts_sql(models) -> str:
    return TEST_SQL + " union all ".join(
        f"select '{m}' as model, count(*) as testing_rows, count(*) filter (where label_learn = 0) as normal_rows, "
        "count(*) filter (where label_learn = 1) as attack_rows, true as f1_reached, true as auc_reached from t" for m in models)


# Fits of the learnable label by query: model, fit, F1 and AUC to reach on the test part.
FITS = {
    "logistic_regression": ("Logistic Regression", lambda t: classifiers.fit_logistic(t, 100.0), 0.9),
    "logistic_regression_lbfgs": ("Logistic Regression", lambda t: classifiers.fit_logistic(t, 100.0, "lbfgs"), 0.9),
    "linear_svm": ("Linear SVM", lambda t: classifiers.fit_linear_svm(t, 100.0), 0.9),
    "linear_svm_hinge": ("Linear SVM", lambda t: classifiers.fit_linear_svm(t, 1.0, "owlqn"), 0.85),
    "random_forest": ("Random Forest", lambda t: classifiers.fit_forest(t), 0.7),
    "multilayer_perceptron": ("ANN", lambda t: classifiers.fit_mlp(t), 0.8),
    "network_adam": ("ANN", lambda t: mlp.fit_mlp_adam(t, "row_id"), 0.8),
    "nearest_neighbours": ("kNN", lambda t: knn.fit_knn(t, "row_id", 15, "distance"), 0.5),
}


def fit_evaluated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All metrics of one of the fits on the events' test part."""
    model, fit, _ = FITS[name]
    _, train, test = _prepared(spark, sf_dir)
    return _evaluated(fit(train), test, model)


for _name, (_model, _, _floor) in FITS.items():
    def _fit_query(spark, sf_dir, name=_name, floor=_floor):
        return _facts(fit_evaluated(spark, sf_dir, name), floor)

    query(_name, _facts_sql([_model]))(_fit_query)


# The balanced training part: the smaller class's training rows twice.
TRAIN_SQL = f"""with {USABLE_SQL}, {_share_sql('u', 'label_learn')}, b as (select 2 * min(share) as training_rows from h)
"""


@query("network_history", TRAIN_SQL + """select training_rows, true as epochs_in_order, true as loss_falls, true as scores_are_shares,
  true as stopped_in_time from b""")
def network_history(spark, sf_dir):
    _, train, _ = _prepared(spark, sf_dir)
    model = mlp.fit_mlp_adam(train, "row_id")
    history = model.epoch_history(spark)
    least = mlp.ARCHITECTURE["n_iter_no_change"]
    facts = history.agg(
        ((F.min("epoch") == 1) & (F.max("epoch") == F.count(F.lit(1)))).alias("epochs_in_order"),
        (F.min_by("loss", -F.col("epoch")) < F.max_by("loss", -F.col("epoch"))).alias("loss_falls"),
        F.bool_and(F.col("validation_score").between(0, 1)).alias("scores_are_shares"),
        F.max("epoch").between(least, mlp.ARCHITECTURE["maximum_epochs"]).alias("stopped_in_time"))
    return train.agg(F.count(F.lit(1)).alias("training_rows")).crossJoin(facts)


@query("feature_importances", f"""with {USABLE_SQL}
select 6 + count(distinct event_type) as columns, 1.0::double as total, true as value_leads from u""")
def feature_importances(spark, sf_dir):
    preprocessor, train, _ = _prepared(spark, sf_dir)
    model = classifiers.fit_forest(train)
    return _importance_facts(classifiers.feature_importances(spark, model, preprocessor.selected))


def _linear_check(name: str, fit_spark: Callable, fit_own: Callable) -> None:
    """Rows whose label by expression differs from the library model's own prediction."""
    def run(spark, sf_dir):
        _, train, test = _prepared(spark, sf_dir)
        model = fit_spark(train.count()).fit(classifiers.training_frame(train))
        scored = fit_own(model).attach(classifiers.with_vector(test), "score", "mine")
        both = model.transform(scored).select("mine", F.col("prediction").cast("int").alias("theirs"))
        return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("mine") != F.col("theirs")).alias("different"))

    query(name, f"""with {USABLE_SQL}
select count(*) - count(*) * 7 // 10 as rows, 0::bigint as different from u""")(run)


_linear_check("logistic_expression", lambda n: classifiers.logistic_estimator(1.0, n, 50),
              lambda m: classifiers.LinearModel([float(w) for w in m.coefficients], float(m.intercept), True, 0.5))
_linear_check("svm_expression", lambda n: classifiers.svm_estimator(1.0, n, 50),
              lambda m: classifiers.LinearModel([float(w) for w in m.coefficients], float(m.intercept), False, 0.0))


@query("compare_models", TEST_SQL + " union all ".join(
    f"select '{m}' as model, count(*) as rows, true as adds_up, true as rate_fits from t" for m in MODEL_ORDER))
def compare_models(spark, sf_dir):
    """All five classifiers over the same test rows, side by side."""
    found = five_models_compared(spark, sf_dir)
    rate = F.abs(F.col("attack_rate") - 100 * F.col("attack") / F.col("rows")) < 0.0051
    return found.select("model", "rows", (F.col("normal") + F.col("attack") == F.col("rows")).alias("adds_up"), rate.alias("rate_fits"))


def _five_models(train: DataFrame) -> dict:
    return {
        "Random Forest": classifiers.fit_forest(train),
        "Logistic Regression": classifiers.fit_logistic(train, 100.0),
        "Linear SVM": classifiers.fit_linear_svm(train, 100.0),
        "kNN": knn.fit_knn(train, "row_id", 5, "distance"),
        "ANN": mlp.fit_mlp_adam(train, "row_id"),
    }


def five_models_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train, test = _prepared(spark, sf_dir)
    return scoring.compare(test, _five_models(train))


def _grid_query(name: str, model: str, floor: float, **settings) -> None:
    """A grid search over all candidates of a model: each once, by number and setting, with a mean F1
    that is a share, and a best one that reaches the floor."""
    def run(spark, sf_dir):
        _, train, _ = _prepared(spark, sf_dir)
        scores = tuning.grid_search(train, model, "row_id", **settings)
        best = scores.agg(F.max("mean_f1_score").alias("best"))
        return train.agg(F.count(F.lit(1)).alias("training_rows")).crossJoin(scores).crossJoin(best).select(
            "training_rows", "candidate", "parameters", F.col("mean_f1_score").between(0, 1).alias("is_share"),
            (F.col("best") >= floor).alias("best_reached"))

    rows = ", ".join(f"({i}, '{json.dumps(c)}')" for i, c in enumerate(tuning.candidates_of(model)))
    query(name, TRAIN_SQL + f"""select training_rows, candidate, parameters, true as is_share, true as best_reached
  from b cross join (values {rows}) c(candidate, parameters)""")(run)


_grid_query("logistic_grid", "Logistic Regression", 0.9)
_grid_query("svm_grid", "Linear SVM", 0.9)
_grid_query("logistic_grid_lbfgs", "Logistic Regression", 0.9, solver="lbfgs")
_grid_query("forest_grid", "Random Forest", 0.7)
_grid_query("network_grid", "ANN", 0.8)


@query("tune_and_refit", _facts_sql(["Logistic Regression"]))
def tune_and_refit(spark, sf_dir):
    _, train, test = _prepared(spark, sf_dir)
    model, _ = tuning.tune_and_fit(train, "Logistic Regression", "row_id")
    return _facts(_evaluated(model, test, "Logistic Regression"), 0.9)


# One recorded candidate of each model whose full grid takes minutes a run.
STUDY_CANDIDATES = {
    "Random Forest": [classifiers.FOREST_CANDIDATES[0]], "kNN": [{"n_neighbors": 5, "weights": "distance"}],
    "ANN": [{"alpha": 1e-4}],
}


def study_statistics(spark: SparkSession, sf_dir: str, models: Sequence[str]) -> DataFrame:
    """Two datasets and all five seeds, from raw rows to the statistics table, with the rows tested."""
    events = surrogate.events(spark, sf_dir)
    shipped = surrogate.shipments(spark, sf_dir).withColumnRenamed("row_key", "row_id")
    documents = study.run_study(
        [(events, EVENTS), (shipped, SHIPMENTS)], "row_id", models=models, candidates=STUDY_CANDIDATES)
    runs, statistics = study.study_tables(materialise(documents, "study-documents"))
    rows = runs.groupBy("dataset", "model").agg(F.sum("testing_rows").alias("testing_rows"))
    return statistics.join(rows, ["dataset", "model"])


def _study_query(name: str, floors: dict[str, float]) -> None:
    """F1 over the runs reaches the model's floor and varies little."""
    def run(spark, sf_dir):
        reached = F.col("f1_score_mean") >= F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])[F.col("model")]
        return study_statistics(spark, sf_dir, tuple(floors)).select(
            "dataset", "model", "runs", "testing_rows", reached.alias("f1_reached"),
            (F.col("f1_score_std") < 0.1).alias("deviation_small"))

    names = ", ".join(f"('{m}')" for m in floors)
    query(name, f"""with {F_SQL}, l as ({SHIPMENTS_SQL}),
u as (select count(*) as n from f where isfinite(rate) and per_k is not null), v as (select count(*) as n from l),
d(dataset, n) as (select 'events', n from u union all select 'shipments', n from v), m(model) as (values {names})
select dataset, model, 5::bigint as runs, 5 * (n - n * 7 // 10)::bigint as testing_rows, true as f1_reached, true as deviation_small
from d cross join m""")(run)


_study_query("multi_seed_study", {"Logistic Regression": 0.85, "Linear SVM": 0.85})


@query("detector_roundtrip", f"""with {SCALED_SQL}
select row_id, case when label_l = 1 then 'Attack' else 'Normal' end as "Prediction" from p""")
def detector_roundtrip(spark, sf_dir):
    df = surrogate.events(spark, sf_dir)
    path = scratch_path(spark, "detector")
    save_pipeline(spark, rule_detector(df), path)
    loaded = load_pipeline(spark, path, EVENTS)
    return loaded.score(df, "Logistic Regression").select("row_id", "Prediction")


# ---- streaming -------------------------------------------------------------------------

def _streamed(spark: SparkSession, sf_dir: str):
    detector = rule_detector(surrogate.events(spark, sf_dir))
    folder = _csv_of_events(spark, sf_dir)
    (header,) = flow_files.header_groups(spark, folder)
    return detector, streams.score_stream(spark, folder, header, detector, ALL_RULES)


@query("streamed_scores", f"""with {SCALED_SQL}
select row_id::varchar as row_id, case when label_l = 1 then 'Attack' else 'Normal' end as "Prediction_Logistic_Regression",
       case when label_s = 1 then 'Attack' else 'Normal' end as "Prediction_Linear_SVM" from p""")
def streamed_scores(spark, sf_dir):
    _, scored = _streamed(spark, sf_dir)
    output = scored.select("row_id", "Prediction_Logistic_Regression", "Prediction_Linear_SVM")
    path = scratch_path(spark, "stream-out")
    writer = streams.available_now(output, scratch_path(spark, "stream-state")).format("parquet")
    writer.start(path).awaitTermination()
    return spark.read.schema(output.schema).parquet(path)


@query("streamed_set_aside", f"""with {SCALED_SQL}
select row_id::varchar as row_id, case when label_s = 1 then 'Attack' else 'Normal' end as state from p where event_type <> 'error'
union all select row_id::varchar, 'cells' from f where event_type = 'error' union all select '1', 'header'""")
def streamed_set_aside(spark, sf_dir):
    """Files in two orders of columns, rows with a cell that is no number, and a file of other columns: the
    stream scores what it can read and keeps the rest aside."""
    events = surrogate.events(spark, sf_dir)
    odd = events.drop("label_rate", "label_learn").withColumn(
        "hour", F.when(F.col("event_type") == "error", "12h").otherwise(F.col("hour").cast("string")))
    folder, scored, aside = (scratch_path(spark, name) for name in ("mixed-csv", "mixed-out", "mixed-aside"))
    even = F.col("row_id") % 2 == 0
    plain = {"header": True, "mode": "append"}
    odd.filter(even).write.csv(folder, **plain)
    odd.filter(~even).select(*reversed(odd.columns)).write.csv(folder, **plain)
    events.limit(1).select(F.lit("1").alias("a"), F.lit("2").alias("b")).write.csv(folder, **plain)
    lines = streams.stream_lines(spark, folder)
    streams.score_lines(lines, odd.columns, rule_detector(events), RULE, scored, aside,
                        scratch_path(spark, "mixed-state")).awaitTermination()
    done = spark.read.schema("row_id string, Prediction string").parquet(scored).select("row_id", F.col("Prediction").alias("state"))
    kept = spark.read.schema("file string, reason string, line string").parquet(aside)
    at = odd.columns.index("row_id")
    cells = F.split("line", ",")
    # Of a reversed line the place counts from the end.
    number = F.when(cells[at].rlike("^[0-9]+$") & (F.size(cells) == len(odd.columns)), cells[at]).otherwise(F.element_at(cells, -1 - at))
    return done.unionByName(kept.select(F.when(F.col("reason") == "header", cells[0]).otherwise(number).alias("row_id"), F.col("reason").alias("state")))


@query("streamed_five_models", f"""with {USABLE_SQL}
select count(*) as rows, count(distinct row_id) as ids, 0::bigint as different from u""")
def streamed_five_models(spark, sf_dir):
    """All five models on a stream, kNN included, give what they give on the same rows at once."""
    df = surrogate.events(spark, sf_dir)
    preprocessor, train, _ = _prepared(spark, sf_dir)
    models = _five_models(train) | {"Random Forest": classifiers.fit_forest(train, n_estimators=20, max_depth=8)}
    detector = Detector(EVENTS, preprocessor, models)
    folder = _csv_of_events(spark, sf_dir)
    (header,) = flow_files.header_groups(spark, folder)
    path = scratch_path(spark, "five-out")
    flows = streams.stream_flows(spark, folder, header, detector)
    streams.score_batches(flows, detector, ALL_RULES, path, scratch_path(spark, "five-state")).awaitTermination()
    columns = list(detector.prediction_columns(ALL_RULES).values())
    streamed = spark.read.parquet(path).select("row_id", F.array(*columns).alias("a"))
    batch = materialise(detector.score(flow_files.read_flows(spark, folder, EVENTS), ALL_RULES), "five-batch").select(
        "row_id", F.array(*columns).alias("b"))
    both = streamed.join(batch, "row_id", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("ids"),
                    F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


@query("streamed_summary", SUMMARY_SQL + """select model, rows, rows - attack as normal, attack,
       round_even(attack::double / rows * 100, 2) as attack_rate from c""")
def streamed_summary(spark, sf_dir):
    detector, scored = _streamed(spark, sf_dir)
    running = streams.stream_summary(scored, detector.prediction_columns(ALL_RULES))
    path = scratch_path(spark, "stream-summary")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = streams.available_now(running, scratch_path(spark, "stream-state"), "complete")
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(running.schema).parquet(path)
