"""Record rules and stream checks, on events bent so that every rule is broken somewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import validate as Q
from tickloom.operators.bars import tick_bars
from tickloom.operators.ordered import by_bars, by_seq
from tickloom.plans.registry import EV, HOURLY, SHUFFLED, TICKS, query, r, rx, seconds
from tickloom.plans.scalars import ALERTS, PREDICTIONS, f32
from tickloom.plans.scans import hourly
from tickloom.sources import fx_views as V

DIRTY = (
    f"{EV}, dirty AS (SELECT event_id AS seq, ts, CASE WHEN k % 17 = 0 THEN 'x_a' ELSE 'x_' || event_type END AS symbol, "
    "CASE WHEN k % 13 = 0 THEN -value WHEN k % 31 = 0 THEN 'nan'::DOUBLE ELSE value END AS bid, "
    "CASE WHEN k % 11 = 0 THEN value ELSE value + 1e-2 * (k + 1) END AS ask, "
    "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 19 = 0 THEN -1e0 ELSE CAST(k AS DOUBLE) END AS volume FROM ev)"
)


def dirty(spark, folder):
    k = V.property_k()
    value = F.col("value")
    return V.read_table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.when(k % 17 == 0, "x_a").otherwise(F.concat(F.lit("x_"), F.col("event_type"))).alias("symbol"),
        F.when(k % 13 == 0, -value).when(k % 31 == 0, F.lit(float("nan"))).otherwise(value).alias("bid"),
        F.when(k % 11 == 0, value).otherwise(value + F.lit(0.01) * (k + 1)).alias("ask"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 19 == 0, F.lit(-1.0)).otherwise(k.cast("double")).alias("volume"),
    )


def _violations(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in rules) + ") AS violations"


def _joined(checked, *keys):
    return checked.select(*keys, F.concat_ws(",", "violations").alias("violations"))


_SYMBOL = ("length(symbol) NOT BETWEEN 6 AND 10", "symbol_length")


@query(
    "v1_validate_ticks",
    f"WITH {DIRTY} SELECT seq, upper(symbol) AS symbol, {rx('coalesce(volume, 0)', 'volume')}, "
    + _violations(
        _SYMBOL,
        ("isnan(bid) OR bid <= 0", "bid_not_positive"),
        ("isnan(ask) OR ask <= 0", "ask_not_positive"),
        ("coalesce(volume, 0) < 0", "volume_negative"),
        (f"NOT {f32('ask')} > {f32('bid')}", "ask_not_above_bid"),
    )
    + " FROM dirty",
)
def ticks(spark, folder):
    return _joined(Q.validate_ticks(dirty(spark, folder)), "seq", "symbol", "volume")


_BENT = (
    f"{HOURLY}, bent AS (SELECT symbol, time, open, CASE WHEN tick_count % 5 = 0 THEN low - 1 ELSE high END AS high, "
    "CASE WHEN tick_count % 7 = 0 THEN open + 1 ELSE low END AS low, CASE WHEN tick_count % 11 = 0 THEN -close ELSE close END AS close, "
    "CASE WHEN tick_count % 3 = 0 THEN -1e0 ELSE volume END AS volume FROM hourly)"
)


def bent(spark, folder):
    n = F.col("tick_count")
    return hourly(spark, folder).select(
        "symbol",
        "time",
        "open",
        F.when(n % 5 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(n % 7 == 0, F.col("open") + 1).otherwise(F.col("low")).alias("low"),
        F.when(n % 11 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(n % 3 == 0, F.lit(-1.0)).otherwise(F.col("volume")).alias("volume"),
    )


@query(
    "v2_validate_bars",
    f"WITH {_BENT} SELECT symbol, time, "
    + _violations(
        _SYMBOL,
        *[(f"isnan({c}) OR {c} <= 0", f"{c}_not_positive") for c in ("open", "high", "low", "close")],
        ("volume < 0", "volume_negative"),
        (f"{f32('high')} < {f32('open')}", "high_below_open"),
        (f"{f32('low')} > {f32('open')}", "low_above_open"),
        (f"{f32('close')} < {f32('low')} OR {f32('close')} > {f32('high')}", "close_outside_range"),
    )
    + " FROM bent",
)
def bars(spark, folder):
    return _joined(Q.validate_bars(bent(spark, folder)), "symbol", "time")


@query(
    "v3_validate_predictions",
    f"WITH {PREDICTIONS} SELECT prediction_id, "
    + _violations(
        _SYMBOL,
        (f"{f32('confidence_score')} NOT BETWEEN 0 AND 1", "score_outside_0_1"),
        (f"{f32('confidence_upper')} < {f32('confidence_lower')}", "upper_below_lower"),
        ("target_timestamp <= predicted_at", "target_not_after_prediction"),
        ("prediction_type NOT IN ('PRICE', 'DIRECTION', 'VOLATILITY')", "unknown_prediction_type"),
        ("length(model_version) > 50", "model_version_too_long"),
    )
    + " FROM p",
)
def predictions(spark, folder):
    return _joined(Q.validate_predictions(V.predictions(spark, folder)), "prediction_id")


@query(
    "v4_validate_alerts",
    f"WITH {ALERTS} SELECT alert_id, "
    + _violations(
        _SYMBOL,
        ("length(message) NOT BETWEEN 1 AND 500", "message_length"),
        ("length(condition) > 200", "condition_too_long"),
        ("alert_type NOT IN ('PRICE_THRESHOLD', 'PATTERN_DETECTED', 'RISK_WARNING')", "unknown_alert_type"),
        ("severity NOT IN ('INFO', 'WARNING', 'CRITICAL')", "unknown_severity"),
        (
            "alert_type = 'PRICE_THRESHOLD' AND current_value IS NOT NULL AND threshold_value IS NULL",
            "threshold_missing",
        ),
    )
    + " FROM a",
)
def alerts(spark, folder):
    return _joined(Q.validate_alerts(V.alerts(spark, folder)), "alert_id")


@query(
    "v6_invalid_bars",
    f"WITH {_BENT} SELECT symbol, time, {r('open', 'high', 'low', 'close', 'volume')} FROM bent WHERE high < low OR open > high "
    "OR open < low OR close > high OR close < low",
)
def invalid(spark, folder):
    return Q.invalid_bars(bent(spark, folder))


@query(
    "v7_drop_non_positive",
    f"WITH {DIRTY} SELECT seq, {r('bid', 'ask')} FROM dirty WHERE bid > 0 AND ask > 0 AND NOT isnan(bid)",
)
def positive(spark, folder):
    return Q.drop_non_positive(dirty(spark, folder)).select("seq", "bid", "ask")


@query(
    "v5_validate_data",
    f"WITH {TICKS} SELECT * FROM (SELECT 'ticks' AS name, 'tick' AS kind, (SELECT count(*) > 0 FROM ticks) AS valid, "
    "CASE WHEN (SELECT count(*) FROM ticks) = 0 THEN 'Data is empty' END AS error UNION ALL "
    "SELECT 'quotes', 'tick', FALSE, 'Missing column: ask' UNION ALL SELECT 'quotes', 'tick', FALSE, 'Missing column: volume' UNION ALL "
    "SELECT 'future', 'tick', (SELECT count(*) > 0 FROM ticks WHERE ts > TIMESTAMP '2030-01-01'), "
    "CASE WHEN (SELECT count(*) FROM ticks WHERE ts > TIMESTAMP '2030-01-01') = 0 THEN 'Data is empty' END UNION ALL "
    "SELECT 'odd', 'candle', FALSE, 'Invalid data type: candle')",
)
def shapes(spark, folder):
    ticks = V.ticks(spark, folder).withColumnRenamed("ts", "timestamp")
    return Q.shape_report(
        {
            "ticks": (ticks, "tick"),
            "quotes": (ticks.drop("ask", "volume"), "tick"),
            "future": (ticks.filter(F.col("timestamp") > "2030-01-01"), "tick"),
            "odd": (ticks, "candle"),
        }
    )


@query(
    "v8_interval_anomalies",
    f"WITH {HOURLY}, d AS (SELECT symbol, lag(time) OVER w AS previous_time, time, {seconds('lag(time) OVER w', 'time')} AS s "
    f"FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY time)) SELECT symbol, previous_time, time, {rx('s', 'interval_seconds')}, "
    "CASE WHEN s > 3600 THEN 'long' ELSE 'short' END AS anomaly FROM d WHERE s > 5400 OR s < 1800",
)
def anomalies(spark, folder):
    return Q.interval_anomalies(hourly(spark, folder), 3600, by_bars(3600))


@query(
    "v9_stream_integrity",
    f"WITH {SHUFFLED}, n AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM timed) SELECT symbol, count(*) AS ticks, "
    "count(*) FILTER (bid <= 0) AS bad_bid, count(*) FILTER (NOT ask > bid) AS bad_spread, count(*) FILTER (volume < 0) AS bad_volume, "
    "count(*) FILTER (ts IS NULL) AS no_timestamp, count(*) FILTER (ts < prev) AS time_reversals FROM n GROUP BY 1",
)
def integrity(spark, folder):
    return Q.stream_integrity(V.shuffled_ticks(spark, folder), by_seq(1 << 26))


@query(
    "v10_cross_record_check",
    f"WITH {PREDICTIONS}, pp AS (SELECT symbol, count(*) AS predictions, max(predicted_at) AS last_p, "
    "count(*) FILTER (NOT target_timestamp > predicted_at) AS bad FROM p GROUP BY 1), e AS (SELECT 'X_' || upper(event_type) AS symbol, "
    "count(*) AS ticks, count(*) AS alerts, count(DISTINCT time_bucket(INTERVAL '1 hour', ts)) AS bars, max(ts) AS last_t FROM ev GROUP BY 1) "
    "SELECT symbol, ticks, bars, predictions, alerts, last_t <= last_p AND bad = 0 AS times_consistent FROM e JOIN pp USING (symbol)",
)
def cross(spark, folder):
    low = F.lower("symbol").alias("symbol")
    ticks = V.ticks(spark, folder)
    alerts = V.alerts(spark, folder)
    return Q.cross_record_check(
        ticks.select(low, "ts"), tick_bars(ticks, "H1"), V.predictions(spark, folder), alerts.select(low)
    )
