"""Column functions on ticks, predictions and alerts. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_DECIMAL = "decimal(28,18)"


def to_float32(value: Column) -> Column:
    return value.cast("float")


def quantise(df: DataFrame, *names: str) -> DataFrame:
    """Cast the named numeric columns to float32; nulls pass."""
    return df.withColumns({n: F.col(n).cast("float") for n in names})


def normalize_symbol(symbol: Column) -> Column:
    return F.upper(symbol)


def spread(bid: Column, ask: Column) -> Column:
    """float32 difference of float32 quotes."""
    return (ask.cast("float") - bid.cast("float")).cast("float")


def mid_price(bid: Column, ask: Column) -> Column:
    return ((bid.cast("float") + ask.cast("float")) / 2).cast("float")


def to_decimal(value: Column) -> Column:
    """Decimal of the double that holds the float32 value.

    Exact for values with at most 18 decimals, which covers every FX price.
    """
    return value.cast("float").cast("double").cast(PRICE_DECIMAL)


def ensure_decimal(value: Column, kind: str) -> Column:
    """Decimal of the float32's own shortest text; decimals pass unchanged."""
    if kind.startswith("decimal"):
        return value
    return value.cast("float").cast("string").cast(PRICE_DECIMAL)


def ticks_to_decimal(ticks: DataFrame) -> DataFrame:
    """``timestamp`` becomes ``time``; quotes and volume become decimals."""
    return ticks.select(
        "symbol",
        F.col("timestamp").alias("time"),
        *[to_decimal(F.col(c)).alias(c) for c in ("bid", "ask", "volume")],
    )


def ticks_to_float(ticks: DataFrame) -> DataFrame:
    """Back to float32. ``time`` wins over ``timestamp``; one of them must exist."""
    source = next((c for c in ("time", "timestamp") if c in ticks.columns), None)
    if source is None:
        raise ValueError("ticks need a 'time' or a 'timestamp' column")
    volume = F.col("volume") if "volume" in ticks.columns else F.lit(None)
    return ticks.select(
        F.col(source).alias("timestamp"),
        "symbol",
        F.col("bid").cast("float").alias("bid"),
        F.col("ask").cast("float").alias("ask"),
        F.coalesce(volume.cast("float"), F.lit(0.0).cast("float")).alias("volume"),
    )


# --- predictions -----------------------------------------------------------


def confidence_range(upper: Column, lower: Column) -> Column:
    return (upper.cast("float") - lower.cast("float")).cast("float")


def is_high_confidence(score: Column) -> Column:
    """The float32 score widened to double against 0.7, so float32(0.7) is not high."""
    return score.cast("float").cast("double") >= F.lit(0.7)


def prediction_horizon_hours(predicted_at: Column, target: Column) -> Column:
    return (F.unix_micros(target) - F.unix_micros(predicted_at)) / F.lit(3_600_000_000.0)


# --- alerts ----------------------------------------------------------------


def is_severity(severity: Column, level: str) -> Column:
    return severity == F.lit(level)


def threshold_exceeded(alert_type: Column, current: Column, threshold: Column) -> Column:
    """Null unless this is a price alert with both values."""
    known = (alert_type == "PRICE_THRESHOLD") & current.isNotNull() & threshold.isNotNull()
    return F.when(known, current.cast("float") > threshold.cast("float"))


def threshold_difference(current: Column, threshold: Column) -> Column:
    return (current.cast("float") - threshold.cast("float")).cast("float")


# --- presentation ----------------------------------------------------------


def spread_points(bid: Column, ask: Column, points_per_unit: int = 100_000) -> Column:
    """Whole points, truncated toward zero."""
    return ((ask - bid) * F.lit(points_per_unit)).cast("long")


def spread_in(bid: Column, ask: Column, point: Column) -> Column:
    return F.try_divide(ask - bid, point)


def spread_pips(points: Column, divisor: float = 100_000.0) -> Column:
    return F.round(points / F.lit(divisor), 1)


def spread_class(spread: Column, tight: float = 0.0001, normal: float = 0.0003) -> Column:
    return F.when(spread < tight, "tight").when(spread < normal, "normal").otherwise("wide")


def direction(value: Column, previous: Column) -> Column:
    """up / down / flat; null when there is no previous value."""
    return (
        F.when(previous.isNull() | value.isNull(), F.lit(None))
        .when(value > previous, "up")
        .when(value < previous, "down")
        .otherwise("flat")
    )


def fixed_text(value: Column, places: int) -> Column:
    """``value`` with ``places`` decimals, rounded as its exact binary value is (halves to even).

    ``format_string`` rounds the shortest decimal text instead, which moves
    values such as 1.255 to the other side. The product with the power of ten is
    taken with its rounding error, so the comparison with one half is exact.
    """
    x, scale = F.abs(value.cast("double")), float(10**places)
    product = x * scale
    split = x * 134217729.0
    high = split - (split - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    rest = product - whole
    odd = whole % 2 == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    units = whole + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    if places == 0:
        return F.concat(sign, units.cast("string"))
    unit = F.lit(10**places)
    before = F.floor(units / unit).cast("string")
    return F.concat(sign, before, F.lit("."), F.lpad((units % unit).cast("string"), places, "0"))


def humanise_volume(volume: Column) -> Column:
    v = volume.cast("double")
    return (
        F.when(v >= 1_000_000, F.concat(fixed_text(v / 1_000_000, 2), F.lit("M")))
        .when(v >= 1_000, F.concat(fixed_text(v / 1_000, 2), F.lit("K")))
        .otherwise(fixed_text(v, 2))
    )


def humanise_duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    return (
        F.when(s < 60, F.concat(fixed_text(s, 0), F.lit("s")))
        .when(s < 3_600, F.concat(fixed_text(s / 60, 1), F.lit("m")))
        .when(s < 86_400, F.concat(fixed_text(s / 3_600, 1), F.lit("h")))
        .otherwise(F.concat(fixed_text(s / 86_400, 1), F.lit("d")))
    )


def gap_impact(seconds: Column, low: float = 10.0, medium: float = 20.0) -> Column:
    return F.when(seconds < low, "Low").when(seconds < medium, "Medium").otherwise("High")


def bar_progress(tick_count: Column, expected: float = 60.0) -> Column:
    """Share of the usual tick count seen so far, in percent, at most 100."""
    return F.least(tick_count / F.lit(expected) * 100, F.lit(100.0))


def bar_elapsed(start: Column, end: Column, now: Column) -> Column:
    """Share of the bar's time that has passed, in percent, within 0…100."""
    done = (F.unix_micros(now) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))
    return F.greatest(F.least(done * 100, F.lit(100.0)), F.lit(0.0))


def display_rows(bars: DataFrame, time: str = "time") -> DataFrame:
    """Formatted time, prices to five places, spread in pips."""
    out = [F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("time_text")]
    out += [F.round(c, 5).alias(c) for c in ("open", "high", "low", "close")]
    out += [F.col(c) for c in ("symbol", "tick_volume", "volume") if c in bars.columns]
    if "spread" in bars.columns:
        out.append(spread_pips(F.col("spread")).alias("spread_pips"))
    return bars.select(*out)
