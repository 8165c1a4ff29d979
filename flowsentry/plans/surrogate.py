"""Flow-like views over the event and shipment test tables.

The test tables hold no network traffic. Events stand in for flows: ``rate`` divides by
the hour and so is infinite at midnight, as byte rates are for flows of no duration, and
``per_k`` is missing where k is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsentry.profiles import FlowProfile

EVENTS = FlowProfile(
    name="events", artifact="events",
    features=("value", "k", "hour", "user_id", "rate", "per_k", "event_type"),
    categoricals=("event_type",), preview=("event_type", "value", "hour"), label="label_learn",
)
SHIPMENTS = FlowProfile(
    name="shipments", artifact="shipments",
    features=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"),
    categoricals=("l_returnflag", "l_linestatus"),
    preview=("l_returnflag", "l_linestatus", "l_quantity"), label="label",
)
# Shipments with as many model inputs as a recorded flow model has.
WIDE = FlowProfile(
    name="wide shipments", artifact="wide_shipments",
    features=(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_partkey",
        "l_suppkey", "unit_price", "net_price", "gross_price", "tax_paid", "rebate", "day_of_year",
        "weekday", "l_returnflag", "l_linestatus"),
    categoricals=("l_returnflag", "l_linestatus"),
    preview=("l_returnflag", "l_linestatus", "l_quantity"), label="label",
)

EVENTS_SQL = """
select event_id as row_id, user_id::double as user_id, value,
       regexp_extract(props, '([0-9]+)', 1)::double as k, hour(ts)::double as hour, event_type,
       case when hour(ts) = 0 then 'infinity'::double else value / hour(ts) end as rate,
       value / nullif(regexp_extract(props, '([0-9]+)', 1)::double, 0) as per_k,
       (event_type = 'error')::int as label_rate,
       (value + regexp_extract(props, '([0-9]+)', 1)::int > 150)::int as label_learn
from events
"""
SHIPMENTS_SQL = """
select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as row_key,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       (l_quantity * (1 - l_discount) > 40)::int as label
from lineitem
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.substring_index(F.substring_index("props", ": ", -1), "}", 1)  # {"k": 42}
    hour = F.hour("ts").cast("double")
    return raw.select(
        F.col("event_id").alias("row_id"), F.col("user_id").cast("double").alias("user_id"), "value",
        k.cast("double").alias("k"), hour.alias("hour"), "event_type",
        F.when(hour == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("value"), hour)).alias("rate"),
        F.try_divide(F.col("value"), k.cast("double")).alias("per_k"),
        (F.col("event_type") == "error").cast("int").alias("label_rate"),
        (F.col("value") + k.cast("int") > 150).cast("int").alias("label_learn"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return raw.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        (F.col("l_quantity") * (1 - F.col("l_discount")) > 40).cast("int").alias("label"),
    )


def wide_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments with further measures of each row: 20 encoded columns in all."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, rest = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return raw.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        *[F.col(c).cast("double").alias(c) for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")],
        (price / F.col("l_quantity")).alias("unit_price"), (price * rest).alias("net_price"),
        (price * rest * (1 + F.col("l_tax"))).alias("gross_price"), (price * F.col("l_tax")).alias("tax_paid"),
        (price * F.col("l_discount")).alias("rebate"),
        F.dayofyear("l_shipdate").cast("double").alias("day_of_year"), F.weekday("l_shipdate").cast("double").alias("weekday"),
        (F.col("l_quantity") * rest > 40).cast("int").alias("label"),
    )
