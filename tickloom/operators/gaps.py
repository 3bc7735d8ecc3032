"""Completeness of bar history: missing periods, gap classes, quality, filling.

Everything works on one row and its neighbour, so history is only sliced by
time; nothing is gathered per symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.ordered import Slicing, by_bars, last_rows, neighbours
from tickloom.operators.quantiles import exact_quantiles

# Month and day of full-day market holidays.
HOLIDAYS = ((12, 25), (1, 1))
_DAY_US = 86_400_000_000


def _interval(timeframe: str | int) -> int:
    return timeframe if isinstance(timeframe, int) else S.timeframe_seconds(timeframe)


def market_closed(
    start: Column, end: Column, holidays: Sequence[tuple[int, int]] = HOLIDAYS
) -> Column:
    """Is a weekend day hit by start, start + 1 day, … ≤ end, or is an end point a holiday?

    Stepping whole days from a weekday reaches Saturday after ``5 - weekday``
    steps, so no day list is built.
    """
    steps = F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(_DAY_US))
    closed = (F.weekday(start) + steps >= 5) & (end >= start)
    for month, day in holidays:
        for at in (start, end):
            closed = closed | ((F.month(at) == month) & (F.dayofmonth(at) == day))
    return closed


def is_gap(seconds: Column, expected: int) -> Column:
    return seconds > F.lit(1.5 * expected)


def intervals(
    bars: DataFrame, timeframe: str | int, keys: Sequence[str] = ("symbol",), time: str = "time",
    slicing: Slicing | None = None,
) -> DataFrame:
    """(keys, start, end, seconds) of each pair of neighbouring rows."""
    slicing = slicing or by_bars(_interval(timeframe), time)
    near = neighbours(bars.select(*keys, time), keys, slicing, prev={"start": time})
    seconds = (F.unix_micros(time) - F.unix_micros("start")) / F.lit(1_000_000.0)
    return near.filter(F.col("start").isNotNull()).select(
        *keys, "start", F.col(time).alias("end"), seconds.alias("gap_seconds")
    )


def detect_missing_periods(
    bars: DataFrame,
    timeframe: str | int,
    keys: Sequence[str] = ("symbol",),
    time: str = "time",
    slicing: Slicing | None = None,
    holidays: Sequence[tuple[int, int]] = HOLIDAYS,
) -> DataFrame:
    """Holes over 1.5 intervals while the market was open.

    ``expected_bars`` counts the intervals in the hole (one more than the bars
    that are missing).
    """
    expected = _interval(timeframe)
    holes = intervals(bars, timeframe, keys, time, slicing).filter(is_gap(F.col("gap_seconds"), expected))
    return holes.filter(~market_closed(F.col("start"), F.col("end"), holidays)).withColumn(
        "expected_bars", F.floor(F.col("gap_seconds") / expected).cast("long")
    )


def missing_rate(
    bars: DataFrame, missing: DataFrame, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Missing share in percent of all bars that should exist."""
    have = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"))
    lost = missing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.sum("expected_bars").alias("missing_bars")
    )
    return have.join(lost, list(keys), "left").select(
        *keys,
        "bars",
        F.coalesce("periods", F.lit(0)).alias("periods"),
        F.coalesce("missing_bars", F.lit(0)).alias("missing_bars"),
        (
            F.coalesce("missing_bars", F.lit(0))
            / (F.col("bars") + F.coalesce("missing_bars", F.lit(0)))
            * 100
        ).alias("missing_rate"),
    )


def _weekend(start: Column, end: Column) -> Column:
    a, b = F.weekday(start), F.weekday(end)
    return ((a == 4) & (b == 0)) | (a >= 5) | (b >= 5)


def classify_gaps(
    bars: DataFrame,
    timeframe: str | int,
    keys: Sequence[str] = ("symbol",),
    time: str = "time",
    slicing: Slicing | None = None,
) -> DataFrame:
    """Every hole over 1.5 intervals as ``weekend``, ``market_closed`` or ``data_gap``."""
    expected = _interval(timeframe)
    start, end = F.col("start"), F.col("end")
    night = (F.hour(start) >= 22) | (F.hour(end) <= 1)
    return (
        intervals(bars, timeframe, keys, time, slicing)
        .filter(is_gap(F.col("gap_seconds"), expected))
        .withColumn("expected_bars", F.floor(F.col("gap_seconds") / expected).cast("long"))
        .withColumn(
            "gap_class",
            F.when(_weekend(start, end), "weekend").when(night, "market_closed").otherwise("data_gap"),
        )
    )


def gap_counts(classified: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps_found"),
        F.count_if(F.col("gap_class") == "weekend").alias("weekend_gaps"),
        F.count_if(F.col("gap_class") == "market_closed").alias("market_closed_gaps"),
        F.count_if(F.col("gap_class") == "data_gap").alias("data_gaps"),
    )


def interval_statistics(
    bars: DataFrame, timeframe: str | int, keys: Sequence[str] = ("symbol",), time: str = "time"
) -> DataFrame:
    """Minimum, maximum, mean and exact median distance of neighbouring rows in seconds."""
    steps = intervals(bars, timeframe, keys, time)
    simple = steps.groupBy(*keys).agg(
        F.min("gap_seconds").alias("min_seconds"),
        F.max("gap_seconds").alias("max_seconds"),
        F.avg("gap_seconds").alias("mean_seconds"),
    )
    middle = exact_quantiles(steps, keys, "gap_seconds", {"median_seconds": 0.5})
    return simple.join(middle, list(keys))


def day_coverage(
    classified: DataFrame, last_gaps: int = 20, last_days: int = 10, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Label of the last days on which one of the last gaps started."""
    recent = last_rows(classified, keys, "start", last_gaps)
    days = recent.groupBy(*keys, F.to_date("start").alias("day")).agg(
        F.bool_or(F.col("gap_class") == "data_gap").alias("__data"),
        F.bool_or(F.col("gap_class") == "weekend").alias("__weekend"),
    )
    labelled = days.select(
        *keys,
        "day",
        F.when(F.col("__data"), "Data Gap").when(F.col("__weekend"), "Weekend").otherwise("Normal").alias("coverage"),
    )
    return last_rows(labelled, keys, "day", last_days)


def quality_score(
    bars: DataFrame,
    classified: DataFrame,
    timeframe: str | int,
    keys: Sequence[str] = ("symbol",),
    time: str = "time",
    start=None,
    end=None,
) -> DataFrame:
    """Coverage of the range, 100 minus ten points per data gap, and a rating.

    The range is the requested one from ``start`` to ``end`` (bars outside do not
    count). Without it, it begins with the key's first bar and ends where its
    last bar ends, so complete history covers 100 %.
    """
    expected = _interval(timeframe)
    begin = F.min(time) if start is None else F.lit(start).cast("timestamp")
    close = F.unix_micros(F.max(time)) + F.lit(int(expected * 1_000_000))
    if end is not None:
        close = F.unix_micros(F.lit(end).cast("timestamp"))
    inside = bars
    if start is not None:
        inside = inside.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside = inside.filter(F.col(time) < F.lit(end).cast("timestamp"))
    have = inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        ((close - F.unix_micros(begin)) / F.lit(1_000_000.0)).alias("span"),
    )
    lost = classified.groupBy(*keys).agg(
        F.count_if(F.col("gap_class") == "data_gap").alias("data_gaps")
    )
    score = F.greatest(F.lit(0), F.lit(100) - F.col("data_gaps") * 10)
    scored = have.join(lost, list(keys), "left").select(
        *keys,
        "bars",
        F.try_divide(F.col("bars") * 100, F.col("span") / expected).alias("coverage_ratio"),
        F.coalesce("data_gaps", F.lit(0)).alias("data_gaps"),
    )
    return scored.withColumn("quality_score", score).withColumn(
        "rating",
        F.when(F.col("quality_score") >= 90, "Excellent")
        .when(F.col("quality_score") >= 70, "Good")
        .when(F.col("quality_score") >= 50, "Fair")
        .when(F.col("quality_score") >= 30, "Poor")
        .otherwise("Very Poor"),
    )


def fill_gaps(
    bars: DataFrame,
    timeframe: str | int,
    method: str = "forward",
    columns: Sequence[str] = ("open", "high", "low", "close"),
    keys: Sequence[str] = ("symbol",),
    time: str = "time",
    slicing: Slicing | None = None,
) -> DataFrame:
    """Add the missing bars between existing ones, by forward, backward or linear filling.

    Each row knows its successor, so it emits itself and the bars of the hole
    behind it; no full time grid is built or joined. A hole is cut into days
    before it is expanded, so no array is longer than a day of bars.
    """
    if method not in ("forward", "backward", "linear"):
        raise ValueError(f"unknown fill method {method!r}")
    step = _interval(timeframe) * 1_000_000
    chunk = max(_DAY_US // step, 1) * step  # microseconds of hole handled by one emitted row
    slicing = slicing or by_bars(_interval(timeframe), time)
    needs = {"__next_time": time}
    if method != "forward":
        needs |= {f"__next_{c}": c for c in columns}
    near = neighbours(bars.select(*keys, time, *columns), keys, slicing, next=needs)
    here = F.unix_micros(time)
    there = F.coalesce(F.unix_micros("__next_time"), here + 1)  # the newest row stands alone
    chunks = near.select("*", F.explode(F.sequence(here, there - 1, F.lit(chunk))).alias("__from"))
    stop = F.least(F.col("__from") + (chunk - step), there - 1)
    grid = chunks.select("*", F.explode(F.sequence("__from", stop, F.lit(step))).alias("__at"))
    share = (F.col("__at") - here) / (there - here)
    filled = {
        "forward": lambda c: F.col(c),
        "backward": lambda c: F.col(f"__next_{c}"),
        "linear": lambda c: F.col(c) + (F.col(f"__next_{c}") - F.col(c)) * share,
    }[method]
    is_filled = F.col("__at") != here
    return grid.select(
        *keys,
        F.timestamp_micros("__at").alias(time),
        *[F.when(is_filled, filled(c)).otherwise(F.col(c)).alias(c) for c in columns],
        is_filled.alias("is_filled"),
    )
