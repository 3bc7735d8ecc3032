"""Projections and scalar functions over ticks, candles, predictions and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions import candles as C
from tickloom.functions import scalars as P
from tickloom.operators.bars import tick_bars
from tickloom.operators.clean import tick_gaps
from tickloom.operators.ordered import by_seq, last_rows
from tickloom.operators.stats import price_direction
from tickloom.plans.registry import EV, HOUR, HOURLY, TICKS, bars_sql, query, r, rx, seconds
from tickloom.plans.scans import hourly
from tickloom.sources import fx_views as V


def f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def d32(expression: str, name: str) -> str:
    """A float32 result, widened and rounded."""
    return rx(f"CAST({expression} AS DOUBLE)", name)


@query(
    "p1_p4_tick_scalars",
    f"WITH {TICKS} SELECT seq, symbol, {d32(f32('bid'), 'bid32')}, "
    f"{d32(f32(f32('ask') + ' - ' + f32('bid')), 'spread')}, "
    f"{d32(f32('(' + f32('ask') + ' + ' + f32('bid') + ') / 2'), 'mid')} FROM ticks",
)
def tick_scalars(spark, folder):
    bid, ask = F.col("bid"), F.col("ask")
    return V.ticks(spark, folder).select(
        "seq",
        P.normalize_symbol(F.lower("symbol")).alias("symbol"),
        P.to_float32(bid).alias("bid32"),
        P.spread(bid, ask).alias("spread"),
        P.mid_price(bid, ask).alias("mid"),
    )


@query(
    "p5_p9_candle_scalars",
    f"WITH {HOURLY}, c AS (SELECT symbol, time, {f32('open')} AS o, {f32('high')} AS h, {f32('low')} AS l, "
    f"{f32('close')} AS c FROM hourly) SELECT symbol, time, {d32('h - l', 'candle_range')}, c > o AS bullish, "
    f"c < o AS bearish, {d32('abs(c - o)', 'body')}, {d32('h - greatest(o, c)', 'upper_shadow')}, "
    f"{d32('least(o, c) - l', 'lower_shadow')} FROM c",
)
def candle_scalars(spark, folder):
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return hourly(spark, folder).select(
        "symbol",
        "time",
        C.candle_range(h, l).alias("candle_range"),
        C.is_bullish(o, c).alias("bullish"),
        C.is_bearish(o, c).alias("bearish"),
        C.body_size(o, c).alias("body"),
        C.upper_shadow(o, h, c).alias("upper_shadow"),
        C.lower_shadow(o, l, c).alias("lower_shadow"),
    )


@query(
    "p10_ticks_to_decimal",
    f"WITH {TICKS} SELECT symbol, ts AS time, {d32(f32('bid'), 'bid')}, {d32(f32('ask'), 'ask')}, "
    f"{d32(f32('volume'), 'volume')} FROM ticks",
)
def decimals(spark, folder):
    return P.ticks_to_decimal(V.ticks(spark, folder).withColumnRenamed("ts", "timestamp"))


@query(
    "p11_ticks_to_float",
    f"WITH {TICKS} SELECT symbol, ts AS timestamp, {d32(f32('bid'), 'bid')}, {d32(f32('ask'), 'ask')}, "
    f"{d32(f32('volume'), 'volume')} FROM ticks",
)
def floats(spark, folder):
    return P.ticks_to_float(P.ticks_to_decimal(V.ticks(spark, folder).withColumnRenamed("ts", "timestamp")))


@query("p12_ensure_decimal", f"WITH {TICKS} SELECT seq, {rx('bid', 'exact_bid')} FROM ticks")
def text_decimals(spark, folder):
    return V.ticks(spark, folder).select("seq", P.ensure_decimal(F.col("bid"), "double").alias("exact_bid"))


_PRED = (
    "p AS (SELECT event_id AS prediction_id, 'X_' || upper(event_type) AS symbol, ts AS predicted_at, "
    "to_timestamp_us AS target_timestamp, CASE k % 4 WHEN 0 THEN 'PRICE' WHEN 1 THEN 'DIRECTION' WHEN 2 THEN "
    "'VOLATILITY' ELSE 'OTHER' END AS prediction_type, value AS predicted_value, k / 96e0 AS confidence_score, "
    "CASE WHEN k % 5 <> 0 THEN value + k % 7 - 1 END AS confidence_upper, CASE WHEN k % 3 <> 0 THEN value END "
    "AS confidence_lower, CASE WHEN k % 2 = 0 THEN repeat('v', k) END AS model_version FROM "
    "(SELECT *, ts + (k - 2) * INTERVAL 1 MINUTE AS to_timestamp_us FROM ev))"
)
PREDICTIONS = f"{EV}, {_PRED}"

ALERTS = (
    f"{EV}, a AS (SELECT event_id AS alert_id, 'X_' || upper(event_type) AS symbol, ts AS timestamp, "
    "CASE k % 4 WHEN 0 THEN 'PRICE_THRESHOLD' WHEN 1 THEN 'PATTERN_DETECTED' WHEN 2 THEN 'RISK_WARNING' ELSE 'NOISE' "
    "END AS alert_type, CASE (k + event_id % 3) % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'CRITICAL' "
    "ELSE 'FATAL' END AS severity, repeat('m', k * 6) AS message, CASE WHEN k % 3 <> 0 THEN 25e0 END AS threshold_value, "
    "CASE WHEN k % 5 <> 0 THEN value END AS current_value, repeat('c', k * 3) AS condition FROM ev)"
)


@query(
    "p13_p15_prediction_scalars",
    f"WITH {PREDICTIONS} SELECT prediction_id, "
    f"{d32(f32('confidence_upper') + ' - ' + f32('confidence_lower'), 'confidence_range')}, "
    f"CAST({f32('confidence_score')} AS DOUBLE) >= 0.7::DOUBLE AS high_confidence, "
    + rx("(epoch_us(target_timestamp) - epoch_us(predicted_at)) / 3.6e9", "horizon_hours")
    + " FROM p",
)
def prediction_scalars(spark, folder):
    return V.predictions(spark, folder).select(
        "prediction_id",
        P.confidence_range(F.col("confidence_upper"), F.col("confidence_lower")).alias("confidence_range"),
        P.is_high_confidence(F.col("confidence_score")).alias("high_confidence"),
        P.prediction_horizon_hours(F.col("predicted_at"), F.col("target_timestamp")).alias("horizon_hours"),
    )


@query(
    "p16_p18_alert_scalars",
    f"WITH {ALERTS} SELECT alert_id, severity = 'CRITICAL' AS critical, severity = 'WARNING' AS warning, "
    "severity = 'INFO' AS info, CASE WHEN alert_type = 'PRICE_THRESHOLD' AND current_value IS NOT NULL AND "
    f"threshold_value IS NOT NULL THEN {f32('current_value')} > {f32('threshold_value')} END AS exceeded, "
    f"{d32(f32('current_value') + ' - ' + f32('threshold_value'), 'difference')} FROM a",
)
def alert_scalars(spark, folder):
    current, threshold = F.col("current_value"), F.col("threshold_value")
    return V.alerts(spark, folder).select(
        "alert_id",
        P.is_severity(F.col("severity"), "CRITICAL").alias("critical"),
        P.is_severity(F.col("severity"), "WARNING").alias("warning"),
        P.is_severity(F.col("severity"), "INFO").alias("info"),
        P.threshold_exceeded(F.col("alert_type"), current, threshold).alias("exceeded"),
        P.threshold_difference(current, threshold).alias("difference"),
    )


@query(
    "p19_timeframe_lookup",
    f"WITH {TICKS}, {bars_sql('h1', HOUR)}, " + bars_sql("d1", "time_bucket(INTERVAL '1 day', ts)")
    + " SELECT 'H1' AS timeframe, 60::BIGINT AS minutes, '1 Hour' AS label, count(*) AS bars FROM h1 "
    "UNION ALL SELECT 'D1', 1440, 'Daily', count(*) FROM d1",
)
def timeframes(spark, folder):
    ticks = V.ticks(spark, folder)
    both = [tick_bars(ticks, t).select(F.lit(t).alias("timeframe")) for t in ("H1", "D1")]
    return (
        both[0]
        .unionByName(both[1])
        .groupBy("timeframe")
        .agg(F.count(F.lit(1)).alias("bars"))
        .withColumns(
            {
                "minutes": S.timeframe_minutes_col(F.col("timeframe")),
                "label": S.timeframe_label_col(F.col("timeframe")),
            }
        )
    )


@query(
    "p20_p21_spread_units",
    f"WITH {TICKS} SELECT seq, CAST(trunc((ask - bid) * 100000) AS BIGINT) AS points, {rx('(ask - bid) / 1e-2', 'in_points')}, "
    "CASE WHEN ask - bid < 0.3::DOUBLE THEN 'tight' WHEN ask - bid < 0.6::DOUBLE THEN 'normal' ELSE 'wide' END AS class FROM ticks",
)
def spread_units(spark, folder):
    bid, ask = F.col("bid"), F.col("ask")
    return V.ticks(spark, folder).select(
        "seq",
        P.spread_points(bid, ask).alias("points"),
        P.spread_in(bid, ask, F.lit(0.01)).alias("in_points"),
        P.spread_class(ask - bid, 0.3, 0.6).alias("class"),
    )


def _dir(c: str) -> str:
    return (
        f"CASE WHEN lag({c}) OVER w IS NULL THEN NULL WHEN {c} > lag({c}) OVER w THEN 'up' "
        f"WHEN {c} < lag({c}) OVER w THEN 'down' ELSE 'flat' END AS {c}_direction"
    )


@query(
    "p22_price_direction",
    f"WITH {TICKS} SELECT symbol, seq, {_dir('bid')}, {_dir('ask')} FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq)",
)
def directions(spark, folder):
    out = price_direction(V.ticks(spark, folder), ["bid", "ask"], by_seq())
    return out.select("symbol", "seq", "bid_direction", "ask_direction")


@query(
    "p20_spread_pips",
    f"WITH {TICKS} SELECT seq, floor(trunc((ask - bid) * 100000) / 1e5 * 10 + 0.5) / 10 AS pips FROM ticks",
)
def pips(spark, folder):
    points = P.spread_points(F.col("bid"), F.col("ask"))
    return V.ticks(spark, folder).select("seq", P.spread_pips(points).alias("pips"))


@query(
    "p23_humanised",
    f"WITH {TICKS}, g AS (SELECT symbol, ts, volume * 12345.5::DOUBLE AS v, "
    f"{seconds('lag(ts) OVER w', 'ts')} AS s FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq)) "
    "SELECT symbol, ts, CASE WHEN v >= 1000000 THEN printf('%.2fM', v / 1000000) WHEN v >= 1000 THEN printf('%.2fK', v / 1000) "
    "ELSE printf('%.2f', v) END AS volume_text, CASE WHEN s < 60 THEN printf('%.0fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) "
    "WHEN s < 86400 THEN printf('%.1fh', s / 3600) ELSE printf('%.1fd', s / 86400) END AS gap_text FROM g WHERE s IS NOT NULL",
)
def humanised(spark, folder):
    from tickloom.operators.ordered import neighbours

    near = neighbours(V.ticks(spark, folder), ["symbol"], by_seq(), prev={"before": "ts"})
    s = (F.unix_micros("ts") - F.unix_micros("before")) / F.lit(1e6)
    return near.filter(s.isNotNull()).select(
        "symbol",
        "ts",
        P.humanise_volume(F.col("volume") * 12345.5).alias("volume_text"),
        P.humanise_duration(s).alias("gap_text"),
    )


@query(
    "p24_gap_impact",
    f"WITH {TICKS}, g AS (SELECT symbol, lag(ts) OVER w AS before, ts AS after, {seconds('lag(ts) OVER w', 'ts')} AS seconds "
    f"FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq)) SELECT symbol, before, after, {r('seconds')}, "
    "CASE WHEN seconds < 3600 THEN 'Low' WHEN seconds < 7200 THEN 'Medium' ELSE 'High' END AS impact FROM g WHERE seconds > 1800",
)
def impacts(spark, folder):
    from tickloom.operators.clean import gap_events

    return gap_events(tick_gaps(V.ticks(spark, folder), 1800.0), 3600.0, 7200.0)


@query(
    "p25_display_rows",
    f"WITH {HOURLY} SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S') AS time_text, {r('open', 'high', 'low', 'close', 'volume')} "
    "FROM hourly QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 20",
)
def display(spark, folder):
    return P.display_rows(last_rows(hourly(spark, folder), ["symbol"], "time", 20))
