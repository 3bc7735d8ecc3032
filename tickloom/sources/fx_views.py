"""FX-shaped views over generic event and order-line tables.

The event table gives quotes (value as bid, a small spread from its property
``k``), the order lines give a large tick volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.ordered import by_seq
from tickloom.session import configure

# Declared, so that planning a query reads no file footers. The files hold zoneless
# instants; read as UTC timestamps they need no cast, so time ranges reach the scan.
TABLES = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp"
    ),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def property_k() -> Column:
    """The one number in ``props`` ({"k": 0…99}); a pattern is cheaper than a JSON parser here."""
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")


def events_as_ticks(events: DataFrame, symbol: Column) -> DataFrame:
    k = property_k()
    return events.select(
        symbol.alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("bid"),
        (F.col("value") + F.lit(0.01) * (k + 1)).alias("ask"),
        k.cast("double").alias("volume"),
    )


def by_type() -> Column:
    return F.concat(F.lit("X_"), F.upper("event_type"))


def by_user() -> Column:
    return F.concat(F.lit("USR"), F.lpad(F.col("user_id").cast("string"), 5, "0"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """A few heavy symbols, one per event type."""
    return events_as_ticks(read_table(spark, folder, "events"), by_type())


def ticks_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """Many light symbols, one per user."""
    return events_as_ticks(read_table(spark, folder, "events"), by_user())


def shuffled_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """``ticks`` in a disturbed arrival order (unique numbers), so some run back in time."""
    disturbed = (F.col("seq") + (F.col("seq") * 7919) % 13) * F.lit(64) + F.col("seq") % 64
    return ticks(spark, folder).withColumn("seq", disturbed)


# One ship date of ``lineitem_ticks`` per slice.
LINEITEM_DAYS = by_seq(1 << 48)


def lineitem_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as ticks: unit price as bid, one symbol per return flag and line status.

    The arrival number follows ship date, order, line and part.
    """
    lines = read_table(spark, folder, "lineitem")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (day * F.lit(1 << 48) + line * 64 + F.col("l_partkey") % 64).alias("seq"),
        price.alias("bid"),
        (price * (F.lit(1.0) + F.col("l_tax") / 100)).alias("ask"),
        F.col("l_quantity").alias("volume"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Forecast records from events: kind and score from ``k``, target one hour ahead."""
    events = read_table(spark, folder, "events")
    k = property_k()
    at = F.col("ts")
    value = F.col("value")
    return events.select(
        F.col("event_id").alias("prediction_id"),
        by_type().alias("symbol"),
        at.alias("predicted_at"),
        F.timestamp_micros(F.unix_micros(at) + (k - 2).cast("long") * 60_000_000).alias("target_timestamp"),
        F.element_at(
            F.array(F.lit("PRICE"), F.lit("DIRECTION"), F.lit("VOLATILITY"), F.lit("OTHER")), k % 4 + 1
        ).alias("prediction_type"),
        value.alias("predicted_value"),
        (k / F.lit(96.0)).alias("confidence_score"),
        F.when(k % 5 != 0, value + k % 7 - 1).alias("confidence_upper"),
        F.when(k % 3 != 0, value).alias("confidence_lower"),
        F.when(k % 2 == 0, F.repeat(F.lit("v"), k)).alias("model_version"),
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert records from events; some break a rule on purpose."""
    events = read_table(spark, folder, "events")
    k = property_k()
    kinds = F.array(F.lit("PRICE_THRESHOLD"), F.lit("PATTERN_DETECTED"), F.lit("RISK_WARNING"), F.lit("NOISE"))
    levels = F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("CRITICAL"), F.lit("FATAL"))
    return events.select(
        F.col("event_id").alias("alert_id"),
        by_type().alias("symbol"),
        F.col("ts").alias("timestamp"),
        F.element_at(kinds, k % 4 + 1).alias("alert_type"),
        F.element_at(levels, (k + F.col("event_id") % 3).cast("int") % 4 + 1).alias("severity"),
        F.repeat(F.lit("m"), k * 6).alias("message"),
        F.when(k % 3 != 0, F.lit(25.0)).alias("threshold_value"),
        F.when(k % 5 != 0, F.col("value")).alias("current_value"),
        F.repeat(F.lit("c"), k * 3).alias("condition"),
    )
