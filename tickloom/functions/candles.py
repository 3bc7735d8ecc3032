"""Column functions on one candle (float32 like the record they describe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f32(value: Column) -> Column:
    return value.cast("float")


def candle_range(high: Column, low: Column) -> Column:
    return _f32(_f32(high) - _f32(low))


def is_bullish(open_: Column, close: Column) -> Column:
    return _f32(close) > _f32(open_)


def is_bearish(open_: Column, close: Column) -> Column:
    return _f32(close) < _f32(open_)


def body_size(open_: Column, close: Column) -> Column:
    return _f32(F.abs(_f32(close) - _f32(open_)))


def upper_shadow(open_: Column, high: Column, close: Column) -> Column:
    return _f32(_f32(high) - F.greatest(_f32(open_), _f32(close)))


def lower_shadow(open_: Column, low: Column, close: Column) -> Column:
    return _f32(F.least(_f32(open_), _f32(close)) - _f32(low))


def candle_type(open_: Column, high: Column, low: Column, close: Column, share: float = 0.1) -> Column:
    """Doji when the body is under a tenth of the range, else by colour."""
    return (
        F.when(F.abs(close - open_) < (high - low) * F.lit(share), "Doji")
        .when(close > open_, "Bullish")
        .otherwise("Bearish")
    )


def is_doji(open_: Column, high: Column, low: Column, close: Column, share: float = 0.1) -> Column:
    """A candle with a range whose body is under a tenth of it."""
    return (high > low) & (F.try_divide(F.abs(close - open_), high - low) < F.lit(share))


def engulfing(open_: Column, close: Column, prev_open: Column, prev_close: Column) -> Column:
    """"Bullish Engulfing", "Bearish Engulfing" or null, from two neighbouring bars."""
    bullish = (close > open_) & (prev_close < prev_open) & (open_ < prev_close) & (close > prev_open)
    bearish = (close < open_) & (prev_close > prev_open) & (open_ > prev_close) & (close < prev_open)
    return F.when(bullish, "Bullish Engulfing").when(bearish, "Bearish Engulfing")
