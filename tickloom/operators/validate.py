"""Record rules. A validator keeps every row and adds ``violations array<string>``;
``good`` and ``quarantine`` split the result without a second pass over Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.ordered import Slicing, neighbours


def _flag(broken: Column, name: str) -> Column:
    return F.when(broken, F.lit(name))


def _with_violations(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def _not_positive(c: str) -> Column:
    # NaN is larger than every number in Spark, so it needs its own test.
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | ~(F.col(c) > 0)


def _outside(value: Column, low: float, high: float) -> Column:
    return F.isnan(value.cast("double")) | ~value.between(low, high)


def good(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


def _symbol_rule() -> Column:
    n = F.length("symbol")
    return _flag(F.col("symbol").isNull() | (n < 6) | (n > 10), "symbol_length")


def validate_ticks(ticks: DataFrame) -> DataFrame:
    """Tick rules; null volume becomes 0 and the symbol is upper-cased after its check."""
    df = ticks.withColumn("volume", F.coalesce("volume", F.lit(0).cast(ticks.schema["volume"].dataType)))
    bid, ask = F.col("bid").cast("float"), F.col("ask").cast("float")
    checked = _with_violations(
        df,
        [
            _symbol_rule(),
            _flag(_not_positive("bid"), "bid_not_positive"),
            _flag(_not_positive("ask"), "ask_not_positive"),
            _flag(F.isnan(F.col("volume").cast("double")) | (F.col("volume") < 0), "volume_negative"),
            _flag(F.coalesce(~(ask > bid), F.lit(True)), "ask_not_above_bid"),
        ],
    )
    return checked.withColumn("symbol", F.upper("symbol"))


def validate_bars(bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x).cast("float") for x in ("open", "high", "low", "close"))
    rules = [_symbol_rule()] if "symbol" in bars.columns else []
    if "timeframe" in bars.columns:
        known = F.coalesce(F.col("timeframe").isin(*S.TIMEFRAME_MINUTES), F.lit(False))
        rules.append(_flag(~known, "unknown_timeframe"))
    rules += [_flag(_not_positive(x), f"{x}_not_positive") for x in ("open", "high", "low", "close")]
    rules += [
        _flag(F.isnan(F.col("volume").cast("double")) | (F.col("volume") < 0), "volume_negative"),
        _flag(h < o, "high_below_open"),
        _flag(l > o, "low_above_open"),
        _flag((c < l) | (c > h), "close_outside_range"),
    ]
    checked = _with_violations(bars, rules)
    return checked.withColumn("symbol", F.upper("symbol")) if "symbol" in bars.columns else checked


def validate_predictions(predictions: DataFrame) -> DataFrame:
    score = F.col("confidence_score").cast("float")
    upper, lower = F.col("confidence_upper").cast("float"), F.col("confidence_lower").cast("float")
    rules = [
        _symbol_rule(),
        _flag(score.isNull() | _outside(score, 0.0, 1.0), "score_outside_0_1"),
        _flag(upper < lower, "upper_below_lower"),
        _flag(~(F.col("target_timestamp") > F.col("predicted_at")), "target_not_after_prediction"),
        _flag(
            ~F.coalesce(F.col("prediction_type").isin(S.PREDICTION_TYPES), F.lit(False)),
            "unknown_prediction_type",
        ),
    ]
    if "model_version" in predictions.columns:
        rules.append(_flag(F.length("model_version") > 50, "model_version_too_long"))
    return _with_violations(predictions, rules).withColumn("symbol", F.upper("symbol"))


def validate_alerts(alerts: DataFrame) -> DataFrame:
    n = F.length("message")
    rules = [
        _symbol_rule(),
        _flag(F.col("message").isNull() | (n < 1) | (n > 500), "message_length"),
        _flag(F.length("condition") > 200, "condition_too_long"),
        _flag(~F.coalesce(F.col("alert_type").isin(S.ALERT_TYPES), F.lit(False)), "unknown_alert_type"),
        _flag(~F.coalesce(F.col("severity").isin(S.SEVERITIES), F.lit(False)), "unknown_severity"),
        _flag(
            (F.col("alert_type") == "PRICE_THRESHOLD")
            & F.col("current_value").isNotNull()
            & F.col("threshold_value").isNull(),
            "threshold_missing",
        ),
    ]
    return _with_violations(alerts, rules).withColumn("symbol", F.upper("symbol"))


# Columns a frame must have.
REQUIRED_COLUMNS = {
    "tick": ["timestamp", "symbol", "bid", "ask", "volume"],
    "ohlc": ["timestamp", "symbol", "open", "high", "low", "close", "volume"],
}


def shape_report(named: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``validate_data`` as rows: name, kind, valid, and one row per error (null where there is none).

    Whether a frame is empty is found by Spark with the other frames' answers, in one job.
    """
    out = None
    for name, (df, kind) in named.items():
        required = REQUIRED_COLUMNS.get(kind)
        if required is None:
            errors = F.array(F.lit(f"Invalid data type: {kind}"))
        else:
            missing = [F.lit(f"Missing column: {c}") for c in required if c not in df.columns]
            empty = F.when(F.col("rows") == 0, F.array(F.lit("Data is empty"))).otherwise(F.array().cast("array<string>"))
            errors = F.concat(empty, F.array(*missing).cast("array<string>"))
        one = df.limit(1).agg(F.count(F.lit(1)).alias("rows"))
        row = one.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), errors.alias("errors"))
        out = row if out is None else out.unionAll(row)
    return out.select("name", "kind", (F.size("errors") == 0).alias("valid"), F.explode_outer("errors").alias("error"))


def validate_data(df: DataFrame, kind: str) -> tuple[bool, list[str]]:
    """Shape check of a frame: known kind, rows present, columns present."""
    if kind not in REQUIRED_COLUMNS:
        return False, [f"Invalid data type: {kind}"]
    errors = [f"Missing column: {c}" for c in REQUIRED_COLUMNS[kind] if c not in df.columns]
    if df.isEmpty():
        errors.insert(0, "Data is empty")
    return not errors, errors


def invalid_bars(bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.filter((h < l) | (o > h) | (o < l) | (c > h) | (c < l))


def drop_non_positive(ticks: DataFrame) -> DataFrame:
    ok = (F.col("bid") > 0) & (F.col("ask") > 0)
    return ticks.filter(ok & ~F.isnan(F.col("bid").cast("double")) & ~F.isnan(F.col("ask").cast("double")))


def interval_anomalies(
    bars: DataFrame, expected_seconds: int, slicing: Slicing, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Neighbouring rows whose distance is over 1.5 or under 0.5 times the expected one."""
    order = slicing.order
    near = neighbours(bars, keys, slicing, prev={"previous_time": order})
    seconds = (F.unix_micros(order) - F.unix_micros("previous_time")) / F.lit(1_000_000.0)
    return (
        near.select(*keys, "previous_time", order, seconds.alias("interval_seconds"))
        .filter(
            (F.col("interval_seconds") > 1.5 * expected_seconds)
            | (F.col("interval_seconds") < 0.5 * expected_seconds)
        )
        .withColumn(
            "anomaly", F.when(F.col("interval_seconds") > expected_seconds, "long").otherwise("short")
        )
    )


def stream_integrity(ticks: DataFrame, slicing: Slicing) -> DataFrame:
    """Per symbol counts of broken stream rules; all zero means a sound stream."""
    near = neighbours(ticks, ["symbol"], slicing, prev={"__prev_ts": "ts"})
    return near.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.count_if(_not_positive("bid")).alias("bad_bid"),
        F.count_if(F.coalesce(~(F.col("ask") > F.col("bid")), F.lit(True))).alias("bad_spread"),
        F.count_if(F.col("volume") < 0).alias("bad_volume"),
        F.count_if(F.col("ts").isNull()).alias("no_timestamp"),
        F.count_if(F.col("ts") < F.col("__prev_ts")).alias("time_reversals"),
    )


def cross_record_check(ticks: DataFrame, bars: DataFrame, predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per upper-cased symbol: which record kinds know it, and whether the time order holds.

    Each input is reduced per symbol first, so the joins are between one-row-per-symbol
    frames: every tick must be no later than some prediction, every target after its
    prediction.
    """
    symbol = F.upper("symbol").alias("symbol")
    t = ticks.groupBy(symbol).agg(F.count(F.lit(1)).alias("ticks"), F.max("ts").alias("last_tick"))
    b = bars.groupBy(symbol).agg(F.count(F.lit(1)).alias("bars"))
    p = predictions.groupBy(symbol).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.max("predicted_at").alias("last_prediction"),
        F.count_if(~(F.col("target_timestamp") > F.col("predicted_at"))).alias("bad_targets"),
    )
    a = alerts.groupBy(symbol).agg(F.count(F.lit(1)).alias("alerts"))
    joined = t.join(b, "symbol", "full").join(p, "symbol", "full").join(a, "symbol", "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ticks", "bars", "predictions", "alerts")]
    return joined.select(
        "symbol",
        *counts,
        F.coalesce(
            (F.col("last_tick") <= F.col("last_prediction")) & (F.col("bad_targets") == 0), F.lit(False)
        ).alias("times_consistent"),
    )
