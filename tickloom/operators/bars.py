"""Ticks to bars and bars to coarser bars.

A bar is one partial + final hash aggregate: the open and close are ``min_by`` /
``max_by`` on the primitive arrival number, so the map side keeps one small
buffer per (symbol, bar) and a hot symbol is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions import scalars as P
from tickloom.operators.ordered import by_bars, last_rows, neighbours


def _price(kind: str, numeric: str) -> Column:
    cast = P.to_decimal if numeric == "decimal" else (lambda c: c.cast("double"))
    if kind == "mid":
        return (cast(F.col("bid")) + cast(F.col("ask"))) / 2
    return cast(F.col(kind))


def tick_bars(
    ticks: DataFrame,
    timeframe: str | int = 60,
    price: str = "bid",
    numeric: str = "double",
    order: str = "seq",
) -> DataFrame:
    """Bars of ``timeframe`` (seconds or a name) from (symbol, ts, seq, bid, ask, volume).

    First and last follow the arrival number, so feed ticks that passed
    ``clean.accepted_ticks``. Intervals without ticks give no row.
    ``numeric="decimal"`` computes on exact decimals of the float32 quotes.
    """
    cast = P.to_decimal if numeric == "decimal" else (lambda c: c.cast("double"))
    quotes = ticks.select(
        "symbol",
        S.bucket_start(F.col("ts"), timeframe).alias("time"),
        F.col(order).alias("__order"),
        _price(price, numeric).alias("__price"),
        cast(F.col("volume")).alias("__volume"),
        (cast(F.col("ask")) - cast(F.col("bid"))).alias("__spread"),
    )
    bars = quotes.groupBy("symbol", "time").agg(
        F.min_by("__price", "__order").alias("open"),
        F.max("__price").alias("high"),
        F.min("__price").alias("low"),
        F.max_by("__price", "__order").alias("close"),
        F.sum("__volume").alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
        F.avg("__spread").alias("avg_spread"),
    )
    return bars.select(
        "symbol",
        "time",
        S.bucket_end(F.col("time"), timeframe).alias("end_time"),
        *bars.columns[2:],
    )


def _seconds(timeframe: str | int) -> int:
    return timeframe if isinstance(timeframe, int) else S.timeframe_seconds(timeframe)


def mark_complete(bars: DataFrame, timeframe: str | int = 60) -> DataFrame:
    """``is_complete``: a later bar of the symbol exists. The newest one is still open."""
    near = neighbours(bars, ["symbol"], by_bars(_seconds(timeframe)), next={"__next": "time"})
    return near.withColumn("is_complete", F.col("__next").isNotNull()).drop("__next")


def completed_bars(bars: DataFrame, timeframe: str | int = 60) -> DataFrame:
    return mark_complete(bars, timeframe).filter("is_complete")


def current_bars(bars: DataFrame) -> DataFrame:
    """The unfinished bar of each symbol."""
    return last_rows(bars, ["symbol"], "time", 1).withColumn("is_complete", F.lit(False))


def retain_newest(bars: DataFrame, max_completed_bars: int, timeframe: str | int = 60) -> DataFrame:
    """The newest ``max_completed_bars`` finished bars of each symbol."""
    newest = last_rows(bars, ["symbol"], "time", max_completed_bars + 1, name="__rank")
    return newest.filter(F.col("__rank") > 1).drop("__rank")


def symbol_summary(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per symbol: ticks, bars, gap events, mean of the bars' spreads."""
    per_symbol = bars.groupBy("symbol").agg(
        F.sum("tick_count").alias("ticks"),
        F.count(F.lit(1)).alias("bars"),
        F.avg("avg_spread").alias("mean_spread"),
    )
    holes = gaps.groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"))
    return per_symbol.join(holes, "symbol", "left").select(
        "symbol", "ticks", "bars", F.coalesce("gaps", F.lit(0)).alias("gaps"), "mean_spread"
    )


def process_tick_to_ohlc(
    ticks: DataFrame, timeframe: str, symbol: str | None = None, price: str = "bid"
) -> DataFrame:
    """OHLC records for a named timeframe, optionally of one symbol; no ticks is an error."""
    tf = S.timeframe(timeframe)
    chosen = ticks.filter(F.col("symbol") == symbol.upper()) if symbol else ticks
    if chosen.isEmpty():
        raise ValueError("no ticks to convert")
    return ohlc_records(tick_bars(chosen, tf, price=price), tf)


def ohlc_records(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars in the layout of fetched history: open time and timeframe name."""
    return bars.select(
        F.col("time").alias("timestamp"),
        "symbol",
        F.lit(S.timeframe(timeframe)).alias("timeframe"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


def broker_bars(ticks: DataFrame, timeframe: str | int = "M1", points_per_unit: int = 100_000) -> DataFrame:
    """Bars as a broker reports them: tick volume and the last tick's spread in points."""
    quotes = ticks.select(
        "symbol",
        S.bucket_start(F.col("ts"), timeframe).alias("time"),
        "seq",
        F.col("bid").cast("double").alias("bid"),
        P.spread_points(F.col("bid"), F.col("ask"), points_per_unit).alias("points"),
    )
    return quotes.groupBy("symbol", "time").agg(
        F.min_by("bid", "seq").alias("open"),
        F.max("bid").alias("high"),
        F.min("bid").alias("low"),
        F.max_by("bid", "seq").alias("close"),
        F.count(F.lit(1)).alias("tick_volume"),
        F.max_by("points", "seq").alias("spread"),
    )


def resample_ohlc(bars: DataFrame, source: str, target: str, time: str = "time") -> DataFrame:
    """Coarser bars from finer ones. A finer target is an error."""
    fine, coarse = S.timeframe(source), S.timeframe(target)
    if S.TIMEFRAME_MINUTES[coarse] < S.TIMEFRAME_MINUTES[fine]:
        raise ValueError(f"cannot resample {fine} to the finer {coarse}")
    marked = bars.withColumn("__bucket", S.bucket_start(F.col(time), coarse))
    return (
        marked.groupBy("symbol", "__bucket")
        .agg(
            F.min_by("open", time).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", time).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("source_bars"),
        )
        .withColumnRenamed("__bucket", time)
    )


def with_progress(bars: DataFrame, expected_ticks: float = 60.0) -> DataFrame:
    return bars.withColumn("progress", P.bar_progress(F.col("tick_count"), expected_ticks))
