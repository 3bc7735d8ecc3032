from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import clean as C
from tickloom.operators.ordered import by_seq

UTC = dt.timezone.utc
MINUTE = [
    (0, 1.0420, 1.0422, 1.0),
    (15, 1.0422, 1.0424, 0.5),
    (30, 1.0418, 1.0420, 1.5),
    (45, 1.0425, 1.0427, 2.0),
    (60, 1.0421, 1.0423, 1.0),
]


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_one_minute_bar(tick_frame):
    first, second = rows(B.mark_complete(B.tick_bars(tick_frame(MINUTE), 60), 60), "time")
    assert (first["open"], first["high"], first["low"], first["close"]) == (1.0420, 1.0425, 1.0418, 1.0425)
    assert first["volume"] == 5.0 and first["tick_count"] == 4
    assert first["time"] == dt.datetime(2025, 1, 20, 10, 0)
    assert first["end_time"] == dt.datetime(2025, 1, 20, 10, 0, 59, 999999)
    assert first["is_complete"] and not second["is_complete"]
    assert math.isclose(first["avg_spread"], 0.0002, rel_tol=1e-6)


def test_current_bar_of_two_ticks(tick_frame):
    (bar,) = rows(B.current_bars(B.tick_bars(tick_frame(MINUTE[:2]), 60)), "time")
    assert (bar["high"], bar["low"], bar["volume"], bar["is_complete"]) == (1.0422, 1.0420, 1.5, False)


def test_decimal_bars_keep_the_float32_text(tick_frame):
    bar = B.tick_bars(tick_frame([(0, 1.042)]), 60, numeric="decimal").first()
    assert str(bar["open"]) == "1.042000055313110400"


def test_five_minutes_of_seconds(tick_frame):
    ticks = tick_frame(
        [(i, 1.1234 + (i % 10) / 10000) for i in range(301)], dt.datetime(2025, 8, 21, 12, tzinfo=UTC)
    )
    done = rows(B.completed_bars(B.tick_bars(ticks, 60), 60), "time")
    assert len(done) == 5
    assert all(b["tick_count"] == 60 and b["volume"] == 60 for b in done)


def test_dense_minute(tick_frame):
    dense = [(i / 10, 1.1234 + (i % 20) / 10000, 1.2, 0.1) for i in range(600)] + [(60, 1.1234, 1.2, 0.1)]
    (bar,) = rows(B.completed_bars(B.tick_bars(tick_frame(dense), 60), 60), "time")
    assert bar["tick_count"] == 600
    assert math.isclose(bar["volume"], 60, rel_tol=1e-6)
    assert math.isclose(bar["high"], 1.1253) and math.isclose(bar["low"], 1.1234)


def test_weekend_gap_makes_no_bars(tick_frame):
    ticks = tick_frame(
        [(dt.datetime(2025, 8, 22, 22, 59, 30, tzinfo=UTC), 1.1), (dt.datetime(2025, 8, 25, 0, 0, 5, tzinfo=UTC), 1.2)]
    )
    made = rows(B.mark_complete(B.tick_bars(ticks, 60), 60), "time")
    assert [b["time"] for b in made] == [dt.datetime(2025, 8, 22, 22, 59), dt.datetime(2025, 8, 25)]
    assert [b["is_complete"] for b in made] == [True, False]
    assert C.tick_gaps(ticks).count() == 1


@pytest.mark.parametrize(("count", "start", "bars"), [(10_000, (2025, 8, 21, 9), 166), (3_601, (2025, 8, 21, 9), 60)])
def test_completed_bar_counts(spark, count, start, bars):
    base = int(dt.datetime(*start, tzinfo=UTC).timestamp())
    ticks = spark.range(count).select(
        F.lit("EURUSD").alias("symbol"),
        F.timestamp_seconds(F.col("id") + base).alias("ts"),
        F.col("id").alias("seq"),
        F.lit(1.1).alias("bid"),
        F.lit(1.2).alias("ask"),
        F.lit(1.0).alias("volume"),
    )
    assert B.completed_bars(B.tick_bars(ticks, 60), 60).count() == bars


def test_late_tick_does_not_reach_the_bar(tick_frame):
    ticks = tick_frame([(0, 1.0), (30, 1.1), (10, 9.0), (30, 1.2)])
    (bar,) = rows(B.tick_bars(C.accepted_ticks(ticks), 60), "time")
    assert (bar["high"], bar["close"], bar["tick_count"]) == (1.2, 1.2, 3)


def test_week_and_month_bars(tick_frame):
    ticks = tick_frame([(0, 1.0), (8 * 86400, 2.0), (20 * 86400, 3.0)])
    weeks = [b["time"] for b in rows(B.tick_bars(ticks, "W1"), "time")]
    assert weeks == [dt.datetime(2025, 1, 20), dt.datetime(2025, 1, 27), dt.datetime(2025, 2, 3)]
    months = rows(B.tick_bars(ticks, "MN1"), "time")
    assert [b["time"] for b in months] == [dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)]
    assert months[1]["end_time"] == dt.datetime(2025, 2, 28, 23, 59, 59, 999999)


def test_process_tick_to_ohlc(tick_frame):
    ticks = tick_frame(MINUTE)
    out = B.process_tick_to_ohlc(ticks, "M1", "eurusd")
    assert out.count() == 2 and out.columns[:3] == ["timestamp", "symbol", "timeframe"]
    with pytest.raises(ValueError):
        B.process_tick_to_ohlc(ticks.limit(0), "M1")
    with pytest.raises(ValueError):
        B.process_tick_to_ohlc(ticks, "M7")


def test_resample(tick_frame):
    fine = B.tick_bars(tick_frame(MINUTE), "M1")
    (bar,) = rows(B.resample_ohlc(fine, "M1", "M5"), "time")
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["volume"]) == (1.0420, 1.0425, 1.0418, 1.0421, 6.0)
    with pytest.raises(ValueError):
        B.resample_ohlc(fine, "H1", "M5")


def test_broker_bars_take_the_last_spread(tick_frame):
    bar = B.broker_bars(tick_frame([(0, 1.0, 1.00012), (5, 1.0, 1.00035)]), "M1").first()
    assert (bar["tick_volume"], bar["spread"]) == (2, int((1.00035 - 1.0) * 100_000))


def test_retention_keeps_the_newest_finished_bars(tick_frame):
    bars = B.tick_bars(tick_frame([(60 * i, 1.0 + i) for i in range(10)]), 60)
    kept = rows(B.retain_newest(bars, 3, 60), "time")
    assert [b["open"] for b in kept] == [7.0, 8.0, 9.0]


def test_slices_do_not_change_completeness(tick_frame):
    ticks = tick_frame([(7 * i % 500, 1.0 + i) for i in range(200)])
    a = rows(C.accepted_ticks(ticks, by_seq(7)), "seq")
    assert a == rows(C.accepted_ticks(ticks), "seq")
