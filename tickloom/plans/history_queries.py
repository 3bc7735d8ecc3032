"""Completeness, gaps and quality of bar history; bar comparison; forecasts and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import alerts as M
from tickloom.operators import bars as B
from tickloom.operators import clean as C
from tickloom.operators import gaps as G
from tickloom.operators import reconcile as J
from tickloom.operators import validate as Q
from tickloom.plans.registry import EV, HOUR, HOURLY, LINES, SHUFFLED, TICKS, bars_sql, query, r, rx, seconds
from tickloom.plans.scalars import ALERTS, PREDICTIONS, f32
from tickloom.plans.scans import hourly
from tickloom.plans.tick_queries import GAPS, WIDE
from tickloom.plans.validation import DIRTY, _SYMBOL, _violations, dirty
from tickloom.session import written
from tickloom.sources import fx_views as V

_STEPS = (
    f"{HOURLY}, steps AS (SELECT symbol, lag(time) OVER w AS start, time AS \"end\", {seconds('lag(time) OVER w', 'time')} AS gap_seconds FROM hourly "
    "WINDOW w AS (PARTITION BY symbol ORDER BY time)), holes AS (SELECT *, CAST(floor(gap_seconds / 3600) AS BIGINT) AS expected_bars FROM steps WHERE gap_seconds > 5400)"
)
# Every day from start on is looked at one by one.
_CLOSED = (
    "(len([d FOR d IN generate_series(start, \"end\", INTERVAL 1 DAY) IF isodow(d) >= 6]) > 0 OR "
    "strftime(start, '%m-%d') IN ('12-25', '01-01') OR strftime(\"end\", '%m-%d') IN ('12-25', '01-01'))"
)


@query(
    "g1_missing_periods",
    f"WITH {_STEPS} SELECT symbol, start, \"end\", {r('gap_seconds')}, expected_bars FROM holes WHERE NOT {_CLOSED}",
)
def missing(spark, folder):
    return G.detect_missing_periods(hourly(spark, folder), "H1")


# Holes of daily bars of single users run over many weekends.
_DAILY = (
    f"{EV}, days AS (SELECT DISTINCT user_id, time_bucket(INTERVAL '1 day', ts) AS time FROM ev), steps AS (SELECT user_id, "
    f"lag(time) OVER w AS start, time AS \"end\", {seconds('lag(time) OVER w', 'time')} AS gap_seconds FROM days WINDOW w AS (PARTITION BY user_id ORDER BY time))"
)


def user_days(spark, folder):
    events = V.read_table(spark, folder, "events")
    return events.select("user_id", F.date_trunc("day", "ts").alias("time")).distinct()


@query(
    "g2_market_closed",
    f"WITH {_DAILY} SELECT user_id, start, \"end\", {_CLOSED} AS closed FROM steps WHERE start IS NOT NULL",
)
def closed(spark, folder):
    steps = G.intervals(user_days(spark, folder), "D1", ("user_id",))
    return steps.select("user_id", "start", "end", G.market_closed(F.col("start"), F.col("end")).alias("closed"))


@query(
    "g3_missing_rate",
    f"WITH {_STEPS}, m AS (SELECT symbol, count(*) AS periods, CAST(sum(expected_bars) AS BIGINT) AS missing_bars FROM holes WHERE NOT {_CLOSED} GROUP BY 1), "
    "b AS (SELECT symbol, count(*) AS bars FROM hourly GROUP BY 1) SELECT symbol, bars, coalesce(periods, 0) AS periods, coalesce(missing_bars, 0) AS missing_bars, "
    + rx("coalesce(missing_bars, 0) / (bars + coalesce(missing_bars, 0))::DOUBLE * 100", "missing_rate")
    + " FROM b LEFT JOIN m USING (symbol)",
)
def rate(spark, folder):
    bars = hourly(spark, folder)
    return G.missing_rate(bars, G.detect_missing_periods(bars, "H1"))


_CLASS = (
    f"{_STEPS}, classed AS (SELECT *, CASE WHEN (isodow(start) = 5 AND isodow(\"end\") = 1) OR isodow(start) >= 6 OR isodow(\"end\") >= 6 THEN 'weekend' "
    "WHEN hour(start) >= 22 OR hour(\"end\") <= 1 THEN 'market_closed' ELSE 'data_gap' END AS gap_class FROM holes)"
)


def classified(spark, folder):
    return G.classify_gaps(hourly(spark, folder), "H1")


@query("g4_gap_classes", f"WITH {_CLASS} SELECT symbol, start, \"end\", {r('gap_seconds')}, expected_bars, gap_class FROM classed")
def classes(spark, folder):
    return classified(spark, folder)


@query(
    "g4_gap_counts",
    f"WITH {_CLASS} SELECT symbol, count(*) AS gaps_found, count(*) FILTER (gap_class = 'weekend') AS weekend_gaps, "
    "count(*) FILTER (gap_class = 'market_closed') AS market_closed_gaps, count(*) FILTER (gap_class = 'data_gap') AS data_gaps FROM classed GROUP BY 1",
)
def counts(spark, folder):
    return G.gap_counts(classified(spark, folder))


@query(
    "g5_interval_statistics",
    f"WITH {_STEPS} SELECT symbol, {rx('min(gap_seconds)', 'min_seconds')}, {rx('max(gap_seconds)', 'max_seconds')}, {rx('avg(gap_seconds)', 'mean_seconds')}, "
    f"{rx('median(gap_seconds)', 'median_seconds')} FROM steps GROUP BY 1",
)
def interval_numbers(spark, folder):
    return G.interval_statistics(hourly(spark, folder), "H1")


@query(
    "g6_day_coverage",
    f"WITH {_CLASS}, few AS (SELECT * FROM classed QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) <= 20), "
    "d AS (SELECT symbol, CAST(CAST(start AS DATE) AS VARCHAR) AS day, CASE WHEN bool_or(gap_class = 'data_gap') THEN 'Data Gap' WHEN bool_or(gap_class = 'weekend') "
    "THEN 'Weekend' ELSE 'Normal' END AS coverage FROM few GROUP BY 1, 2) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) <= 10",
)
def coverage(spark, folder):
    return G.day_coverage(classified(spark, folder))


@query(
    "g7_quality_score",
    f"WITH {_CLASS}, b AS (SELECT symbol, count(*) AS bars, {seconds('min(time)', 'max(time)')} + 3600 AS span FROM hourly GROUP BY 1), "
    "g AS (SELECT symbol, count(*) AS n FROM classed WHERE gap_class = 'data_gap' GROUP BY 1), s AS (SELECT symbol, bars, bars / (span / 3600) * 100 AS coverage_ratio, "
    "coalesce(n, 0) AS data_gaps, greatest(0, 100 - 10 * coalesce(n, 0)) AS quality_score FROM b LEFT JOIN g USING (symbol)) "
    f"SELECT symbol, bars, {r('coverage_ratio')}, data_gaps, quality_score, CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 70 THEN 'Good' "
    "WHEN quality_score >= 50 THEN 'Fair' WHEN quality_score >= 30 THEN 'Poor' ELSE 'Very Poor' END AS rating FROM s",
)
def quality(spark, folder):
    return G.quality_score(hourly(spark, folder), classified(spark, folder), "H1")


@query(
    "g7_quality_score_of_range",
    f"WITH {_CLASS}, b AS (SELECT symbol, count(*) AS bars FROM hourly WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-12' GROUP BY 1), "
    "g AS (SELECT symbol, count(*) AS n FROM classed WHERE gap_class = 'data_gap' GROUP BY 1) "
    f"SELECT symbol, bars, {rx('bars * 100 / 168.0', 'coverage_ratio')}, coalesce(n, 0) AS data_gaps FROM b LEFT JOIN g USING (symbol)",
)
def quality_of_range(spark, folder):
    scored = G.quality_score(
        hourly(spark, folder), classified(spark, folder), "H1", start="2024-01-05", end="2024-01-12"
    )
    return scored.select("symbol", "bars", "coverage_ratio", "data_gaps")


def _fill(method: str) -> str:
    value = {
        "forward": "last_value({c} IGNORE NULLS) OVER w",
        "backward": "first_value({c} IGNORE NULLS) OVER v",
        "linear": "coalesce({c}, last_value({c} IGNORE NULLS) OVER w + (first_value({c} IGNORE NULLS) OVER v - last_value({c} IGNORE NULLS) OVER w) "
        "* (epoch_us(time) - epoch_us(last_value(bt IGNORE NULLS) OVER w)) / (epoch_us(first_value(bt IGNORE NULLS) OVER v) - epoch_us(last_value(bt IGNORE NULLS) OVER w)))",
    }[method]
    return (
        f"WITH {HOURLY}, ends AS (SELECT symbol, min(time) AS a, max(time) AS z FROM hourly GROUP BY 1), grid AS (SELECT symbol, "
        "unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS time FROM ends), j AS (SELECT g.symbol, g.time, h.time AS bt, open, high, low, close FROM grid g "
        "LEFT JOIN hourly h ON g.symbol = h.symbol AND g.time = h.time) SELECT symbol, time, "
        + ", ".join(rx(value.format(c=c), c) for c in ("open", "high", "low", "close"))
        + ", bt IS NULL AS is_filled FROM j WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "v AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


for _method in ("forward", "backward", "linear"):

    @query(f"g8_fill_{_method}", _fill(_method))
    def _filled(spark, folder, method=_method):
        return G.fill_gaps(hourly(spark, folder), "H1", method)


# --- comparison of sources and timeframes -------------------------------------
#
# The broker's bars are built from the ticks with volume of at least 10, so some
# bars differ and some are absent.

_PAIR = (
    f"{HOURLY}, thin AS (SELECT * FROM ticks WHERE volume >= 10), {bars_sql('broker', HOUR, 'thin')}, diffs AS (SELECT h.symbol, h.time, "
    "abs(h.open - b.open) AS open_diff, abs(h.high - b.high) AS high_diff, abs(h.low - b.low) AS low_diff, abs(h.close - b.close) AS close_diff, "
    "h.tick_count AS tick_volume_tick, b.tick_count AS tick_volume_broker FROM hourly h LEFT JOIN broker b ON h.symbol = b.symbol AND h.time = b.time), "
    "compared AS (SELECT *, coalesce(greatest(open_diff, high_diff, low_diff, close_diff) <= 1e-5, FALSE) AS match, "
    "100 - (open_diff + high_diff + low_diff + close_diff) * 10000 AS accuracy, CASE WHEN tick_volume_broker IS NULL THEN 'No MT5 bar found' END AS reason FROM diffs)"
)


def compared(spark, folder):
    ticks = V.ticks(spark, folder)
    return J.compare_bars(B.tick_bars(ticks, "H1"), B.broker_bars(ticks.filter(F.col("volume") >= 10), "H1"))


@query(
    "j1_bar_comparison",
    f"WITH {_PAIR} SELECT symbol, time, match, {r('open_diff', 'high_diff', 'low_diff', 'close_diff')}, tick_volume_tick, tick_volume_broker, {r('accuracy')}, reason FROM compared",
)
def comparison(spark, folder):
    return compared(spark, folder)


@query(
    "j2_reconciliation_summary",
    f"WITH {_PAIR} SELECT symbol, count(*) AS compared, count(*) FILTER (match) AS matches, {rx('count(*) FILTER (match) * 100 / count(*)::DOUBLE', 'match_percent')}, "
    f"{rx('avg(accuracy)', 'mean_accuracy')} FROM compared WHERE reason IS NULL GROUP BY 1",
)
def reconciliation(spark, folder):
    return J.reconciliation_summary(compared(spark, folder), ["symbol"])


@query(
    "j3_timeframe_consistency",
    f"WITH {HOURLY}, h AS (SELECT symbol, time_bucket(INTERVAL '4 hours', h.time) AS time, max(high) AS fine_high, min(low) AS fine_low, sum(volume) AS fine_volume, count(*) AS fine_bars "
    f"FROM hourly h WHERE tick_count > 1 GROUP BY 1, 2), {bars_sql('d', 'time_bucket(INTERVAL 4 hours, ts)')} SELECT symbol, time, {r('high', 'low', 'volume', 'fine_high', 'fine_low', 'fine_volume')}, "
    "coalesce(fine_bars, 0) AS fine_bars, coalesce(fine_bars = 4, FALSE) AS is_full, CASE WHEN fine_bars = 4 THEN abs(high - fine_high) < 1e-4 AND abs(low - fine_low) < 1e-4 END AS price_consistent, "
    "CASE WHEN fine_bars = 4 THEN abs(volume - fine_volume) < 1e-6 END AS volume_consistent FROM d LEFT JOIN h USING (symbol, time)",
)
def consistency(spark, folder):
    # Hours with a single tick are left out, so not every coarse bar is covered.
    fine = hourly(spark, folder).filter(F.col("tick_count") > 1)
    return J.timeframe_consistency(fine, B.tick_bars(V.ticks(spark, folder), "H4"), "H1", "H4")


# --- forecasts and alerts ------------------------------------------------------


@query(
    "m1_confidence_alerts",
    f"WITH {PREDICTIONS} SELECT symbol, predicted_at AS timestamp, 'PATTERN_DETECTED' AS alert_type, 'WARNING' AS severity, "
    "'High confidence ' || prediction_type || ' prediction' AS message, 0.8::DOUBLE AS threshold_value, "
    f"{rx('CAST(CAST(confidence_score AS FLOAT) AS DOUBLE)', 'current_value')}, 'confidence_score > 0.8' AS condition, FALSE AS acknowledged "
    f"FROM p WHERE CAST({f32('confidence_score')} AS DOUBLE) > 0.8::DOUBLE",
)
def confidence(spark, folder):
    return M.confidence_alerts(V.predictions(spark, folder)).drop("metadata")


@query(
    "m2_momentum_alerts",
    f"WITH {HOURLY}, {PREDICTIONS.removeprefix(EV + ', ')}, d AS (SELECT * FROM p WHERE prediction_type = 'DIRECTION'), m AS (SELECT h.symbol, h.time AS bar_time, "
    "d.predicted_at AS timestamp, d.confidence_score AS score, row_number() OVER (PARTITION BY h.symbol, h.time ORDER BY d.predicted_at, d.confidence_score) AS n "
    f"FROM hourly h JOIN d ON d.symbol = h.symbol AND d.predicted_at >= h.time WHERE {f32('h.close')} > {f32('h.open')}) SELECT symbol, bar_time, timestamp, "
    "CASE WHEN score > 0.85::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Strong bullish momentum detected' AS message FROM m WHERE n = 1",
)
def momentum(spark, folder):
    out = M.momentum_alerts(hourly(spark, folder), V.predictions(spark, folder))
    return out.select("symbol", "bar_time", "timestamp", "severity", "message")


_RULES = "rules AS (SELECT symbol, avg(bid) * 2 AS threshold, 'WARNING' AS severity FROM ticks GROUP BY 1)"


@query(
    "m3_price_threshold_alerts",
    f"WITH {TICKS}, {_RULES} SELECT symbol, ts AS timestamp, severity, {rx('CAST(CAST(threshold AS FLOAT) AS DOUBLE)', 'threshold_value')}, "
    f"{rx('CAST(CAST(bid AS FLOAT) AS DOUBLE)', 'current_value')}, {rx(f'CAST(' + f32('bid') + ' - ' + f32('threshold') + ' AS DOUBLE)', 'difference')} "
    f"FROM ticks JOIN rules USING (symbol) WHERE {f32('bid')} > {f32('threshold')}",
)
def thresholds(spark, folder):
    ticks = V.ticks(spark, folder)
    rules = ticks.groupBy("symbol").agg((F.avg("bid") * 2).alias("threshold"), F.lit("WARNING").alias("severity"))
    out = M.price_threshold_alerts(ticks, written(rules, "rules"))
    return out.select("symbol", "timestamp", "severity", "threshold_value", "current_value", "difference")


@query(
    "m4_pipeline_alerts",
    f"WITH {GAPS}, kept AS (SELECT * FROM timed WHERE last_ts IS NULL OR ts >= last_ts), {bars_sql('b', HOUR, 'kept')}, "
    + DIRTY.replace(EV + ", ", "")
    + ", done AS (SELECT symbol, time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS n FROM b), bad AS (SELECT upper(symbol) AS symbol, ts, "
    + _violations(
        _SYMBOL,
        ("isnan(bid) OR bid <= 0", "bid_not_positive"),
        ("isnan(ask) OR ask <= 0", "ask_not_positive"),
        ("coalesce(volume, 0) < 0", "volume_negative"),
        (f"NOT {f32('ask')} > {f32('bid')}", "ask_not_above_bid"),
    )
    + " FROM dirty) SELECT symbol, time + INTERVAL '1 hour' - INTERVAL '1 microsecond' AS timestamp, 'INFO' AS level, 'bar completed' AS message FROM done WHERE n IS NOT NULL "
    "UNION ALL SELECT symbol, ts, 'WARNING', 'tick gap' FROM gaps UNION ALL SELECT symbol, ts, 'ERROR', violations FROM bad WHERE violations <> ''",
)
def pipeline(spark, folder):
    ticks = V.shuffled_ticks(spark, folder)
    done = B.completed_bars(B.tick_bars(C.accepted_ticks(ticks, WIDE), "H1"), "H1")
    return M.pipeline_alerts(
        done, C.tick_gaps(ticks, 3600.0, WIDE), Q.quarantine(Q.validate_ticks(dirty(spark, folder)))
    )


_NAIVE = (
    f"{HOURLY}, naive AS (SELECT symbol, time AS predicted_at, time + INTERVAL '1 hour' AS target_timestamp, CAST({f32('close * 1.001::DOUBLE')} AS DOUBLE) AS predicted_value, "
    f"CAST({f32('close * 1.002::DOUBLE')} AS DOUBLE) AS confidence_upper, CAST({f32('close * 1.0005::DOUBLE')} AS DOUBLE) AS confidence_lower FROM hourly)"
)


@query(
    "m5_evaluate_forecasts",
    f"WITH {_NAIVE}, e AS (SELECT n.symbol, predicted_value - close AS e, close AS a FROM naive n JOIN hourly h ON n.symbol = h.symbol AND n.target_timestamp = h.time) "
    f"SELECT symbol, count(*) AS pairs, {rx('avg(abs(e))', 'mae')}, {rx('sqrt(avg(e * e))', 'rmse')}, {rx('avg(abs(e) / nullif(abs(a), 0)) * 100', 'mape')} FROM e GROUP BY 1",
)
def evaluation(spark, folder):
    bars = hourly(spark, folder)
    return M.evaluate_forecasts(M.naive_forecasts(bars, 3600), bars)


@query(
    "m6_naive_forecasts",
    f"WITH {_NAIVE} SELECT symbol, predicted_at, target_timestamp, 'PRICE' AS prediction_type, 0.75::DOUBLE AS confidence_score, "
    f"{r('predicted_value', 'confidence_upper', 'confidence_lower')} FROM naive QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY predicted_at DESC) = 1",
)
def forecasts(spark, folder):
    out = M.naive_forecasts(M.latest_bars(hourly(spark, folder)), 3600)
    return out.drop("model_version", "metadata")


@query(
    "m7_recent_alerts",
    f"WITH {ALERTS} SELECT alert_id, symbol, timestamp, severity AS level FROM a ORDER BY timestamp DESC, alert_id LIMIT 5",
)
def recent(spark, folder):
    alerts = V.alerts(spark, folder).select("alert_id", "symbol", "timestamp", F.col("severity").alias("level"))
    return M.recent_alerts(alerts)
