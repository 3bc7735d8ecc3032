"""Forecast rows, their evaluation, and alerts drawn from forecasts, bars and ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions.candles import is_bullish
from tickloom.functions.scalars import threshold_difference
from tickloom.operators.ordered import Slicing, by_time, last_rows, nearest


def _alert(
    df: DataFrame,
    timestamp: str | Column,
    alert_type: str,
    severity: Column,
    message: Column,
    *,
    threshold: Column | None = None,
    current: Column | None = None,
    condition: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Project to the alert layout."""
    made = {
        "symbol": F.col("symbol"),
        "timestamp": F.col(timestamp) if isinstance(timestamp, str) else timestamp,
        "alert_type": F.lit(alert_type),
        "severity": severity,
        "message": message,
        "threshold_value": threshold,
        "current_value": current,
        "condition": condition,
        "metadata": None,
        "acknowledged": F.lit(False),
    }
    out = []
    for field in S.ALERT.fields:
        value = made[field.name]
        out.append((F.lit(None) if value is None else value).cast(field.dataType).alias(field.name))
    return df.select(*out, *extra)


def confidence_alerts(predictions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A warning for each prediction whose float32 score is above ``threshold``."""
    score = F.col("confidence_score").cast("float").cast("double")
    return _alert(
        predictions.filter(score > threshold),
        "predicted_at",
        "PATTERN_DETECTED",
        F.lit("WARNING"),
        F.concat(F.lit("High confidence "), F.col("prediction_type"), F.lit(" prediction")),
        threshold=F.lit(threshold),
        current=F.col("confidence_score"),
        condition=F.lit(f"confidence_score > {threshold}"),
    )


def momentum_alerts(
    bars: DataFrame,
    predictions: DataFrame,
    critical: float = 0.85,
    slicing: Slicing | None = None,
    time: str = "time",
) -> DataFrame:
    """Bullish bars with the next DIRECTION prediction of their symbol at or after the bar.

    Bars and predictions are laid on one time line per symbol and looked up with
    a carried "next prediction"; nothing is joined pair by pair.
    """
    slicing = slicing or by_time(7 * 86_400, "at")
    rows = bars.filter(is_bullish(F.col("open"), F.col("close"))).select(
        "symbol", F.col(time).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("score")
    )
    ahead = predictions.filter(F.col("prediction_type") == "DIRECTION").select(
        "symbol",
        F.col("predicted_at").alias("at"),
        F.lit(1).alias("side"),
        F.col("confidence_score").cast("double").alias("score"),
    )
    payload = F.when(F.col("side") == 1, F.struct(F.col("at").alias("predicted_at"), "score"))
    found = nearest(
        rows.unionByName(ahead), ["symbol"], slicing, payload, "hit", "forward", tie=("side", "score")
    ).filter((F.col("side") == 0) & F.col("hit").isNotNull())
    found = found.select(
        "symbol", F.col("at").alias("bar_time"), F.col("hit.predicted_at").alias("predicted_at"), F.col("hit.score").alias("score")
    )
    level = F.when(F.col("score") > critical, "CRITICAL").otherwise("WARNING")
    return _alert(
        found,
        "predicted_at",
        "PATTERN_DETECTED",
        level,
        F.lit("Strong bullish momentum detected"),
        condition=F.lit(f"is_bullish=True and confidence>{critical}"),
        current=F.col("score"),
        extra=("bar_time",),
    )


def price_threshold_alerts(
    quotes: DataFrame,
    rules: DataFrame,
    price: str = "bid",
    time: str = "ts",
) -> DataFrame:
    """Alerts for quotes above a rule's threshold at float32.

    ``rules`` has symbol, threshold, severity. Spark broadcasts it below its byte
    threshold; a larger table is joined by shuffle, where adaptive skew handling
    splits a hot symbol.
    """
    joined = quotes.join(rules.select("symbol", "threshold", "severity"), "symbol")
    current, threshold = F.col(price).cast("float"), F.col("threshold").cast("float")
    return _alert(
        joined.filter(current > threshold).withColumn("difference", threshold_difference(current, threshold)),
        time,
        "PRICE_THRESHOLD",
        F.col("severity"),
        F.concat(F.lit("Price above threshold for "), F.col("symbol")),
        threshold=threshold,
        current=current,
        condition=F.lit("current_value > threshold_value"),
        extra=("difference",),
    )


def pipeline_alerts(completed: DataFrame, gaps: DataFrame, rejected: DataFrame) -> DataFrame:
    """One log line per finished bar (INFO), gap (WARNING) and rejected row (ERROR).

    ``completed`` has symbol, end_time; ``gaps`` has symbol, ts, gap_seconds;
    ``rejected`` has symbol, ts, violations.
    """
    bars = completed.select(
        "symbol", F.col("end_time").alias("timestamp"), F.lit("INFO").alias("level"), F.lit("bar completed").alias("message")
    )
    holes = gaps.select(
        "symbol", F.col("ts").alias("timestamp"), F.lit("WARNING").alias("level"), F.lit("tick gap").alias("message")
    )
    errors = rejected.select(
        "symbol",
        F.col("ts").alias("timestamp"),
        F.lit("ERROR").alias("level"),
        F.concat_ws(",", "violations").alias("message"),
    )
    return bars.unionByName(holes).unionByName(errors)


def recent_alerts(alerts: DataFrame, n: int = 5, time: str = "timestamp") -> DataFrame:
    """The newest ``n`` alerts over all symbols."""
    return alerts.orderBy(F.desc(time), *[c for c in alerts.columns if c != time and c != "metadata"]).limit(n)


METRICS = ("mae", "rmse", "mape")


def evaluate_forecasts(
    predictions: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str] = ("symbol",),
    price: str = "close",
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Pairs and the chosen metrics of predictions against the bar at their target time; unknown ones are an error."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown or not metrics:
        raise ValueError(f"unknown metrics {unknown}; known: {list(METRICS)}")
    truth = actuals.select("symbol", F.col("time").alias("target_timestamp"), F.col(price).cast("double").alias("actual"))
    joined = predictions.join(truth, ["symbol", "target_timestamp"])
    error = F.col("predicted_value").cast("double") - F.col("actual")
    made = {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.try_divide(F.abs(error), F.abs(F.col("actual")))) * 100,
    }
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), *[made[m].alias(m) for m in dict.fromkeys(metrics)])


def naive_forecasts(
    bars: DataFrame,
    horizon_seconds: int = 300,
    time: str = "time",
    predicted_at: Column | None = None,
) -> DataFrame:
    """Baseline interval forecast from each given bar (take ``latest_bars`` for the last one)."""
    close = F.col("close").cast("double")
    made = {
        "symbol": F.col("symbol"),
        "predicted_at": predicted_at if predicted_at is not None else F.col(time),
        "target_timestamp": F.timestamp_micros(F.unix_micros(time) + F.lit(horizon_seconds * 1_000_000)),
        "prediction_type": F.lit("PRICE"),
        "predicted_value": close * 1.001,
        "confidence_score": F.lit(0.75),
        "confidence_upper": close * 1.002,
        "confidence_lower": close * 1.0005,
        "model_version": None,
        "metadata": None,
    }
    return bars.select(
        *[
            (F.lit(None) if made[f.name] is None else made[f.name]).cast(f.dataType).alias(f.name)
            for f in S.PREDICTION.fields
        ]
    )


def latest_bars(bars: DataFrame, time: str = "time") -> DataFrame:
    return last_rows(bars, ["symbol"], time, 1)
