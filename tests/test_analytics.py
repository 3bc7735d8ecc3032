"""Indicators, statistics, gaps, reconciliation and alerts."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import alerts as M
from tickloom.operators import bars as B
from tickloom.operators import gaps as G
from tickloom.operators import indicators as I
from tickloom.operators import ordered
from tickloom.operators import reconcile as J
from tickloom.operators import stats as A
from tickloom.operators.ordered import by_seq, by_time
from tickloom.operators.quantiles import exact_quantiles

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 8, tzinfo=UTC)  # a Monday


@pytest.fixture
def bar_frame(spark):
    def build(closes, symbol="EURUSD", step=3600, start=START, opens=None, at=None):
        rows = []
        for i, c in enumerate(closes):
            o = opens[i] if opens else c
            seconds = (at[i] if at else i) * step
            rows.append((symbol, start + dt.timedelta(seconds=seconds), float(o), max(o, c) + 0.5, min(o, c) - 0.5, float(c), 1.0 + i))
        return spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume double")

    return build


def column(df, name, order="time"):
    return pd.Series([r[name] for r in df.orderBy(order).collect()], dtype="float64")


def walk(n, seed=4):
    return (100 + np.random.default_rng(seed).normal(0, 0.2, n).cumsum()).round(4).tolist()


def close_to(a, b, tol=1e-9):
    return np.allclose(a.fillna(-1e9), b.fillna(-1e9), rtol=tol, atol=1e-9)


# Slices of half a day and blocks barely longer than the halo: many seams.
SEAMS = {"slicing": by_time(43_200), "block_rows": 16}


def test_sma_of_thirty_bars(bar_frame):
    out = I.calculate_indicators(bar_frame([150.05 + 0.01 * i for i in range(30)]), ["SMA"], period=10)
    values = column(out, "SMA_10")
    assert values[:9].isna().all() and np.isclose(values[9], np.mean([150.05 + 0.01 * i for i in range(10)]))


def test_averages_and_bands_across_seams(bar_frame):
    x = walk(200)
    df, s = bar_frame(x), pd.Series(x)
    out = I.moving_averages(df, (5, 20, 50), **SEAMS)
    for n in (5, 20, 50):
        assert close_to(column(out, f"MA{n}"), s.rolling(n).mean())
    bb = I.bollinger(df, **SEAMS)
    assert close_to(column(bb, "bb_upper"), s.rolling(20).mean() + 2 * s.rolling(20).std(), 1e-7)
    assert close_to(column(bb, "bb_lower"), s.rolling(20).mean() - 2 * s.rolling(20).std(), 1e-7)
    last = I.latest(bb).first()
    assert last["close"] == x[-1]


def test_recursive_averages_across_seams(bar_frame):
    x = walk(1500)
    df, s = bar_frame(x), pd.Series(x)
    seams = {"slicing": by_time(86_400 * 3), "block_rows": 16}
    out = I.ema(df, [5, 20], **seams)
    for n in (5, 20):
        assert close_to(column(out, f"EMA_{n}"), s.ewm(span=n, adjust=False).mean(), 1e-13)
    e = lambda v, n: v.ewm(span=n, adjust=False).mean()
    m = I.macd(df, **seams)
    line = e(s, 12) - e(s, 26)
    assert np.allclose(column(m, "macd"), line, atol=1e-11)
    assert np.allclose(column(m, "macd_signal"), e(line, 9), atol=1e-11)
    d = s.diff()
    gain, loss = d.clip(lower=0), -d.clip(upper=0)
    g, l = gain[1:15].mean(), loss[1:15].mean()
    expected = [np.nan] * 14 + [100 - 100 / (1 + g / l)]
    for i in range(15, len(x)):
        g, l = (g * 13 + gain[i]) / 14, (l * 13 + loss[i]) / 14
        expected.append(100 - 100 / (1 + g / l))
    assert close_to(column(I.rsi(df, **seams), "RSI_14"), pd.Series(expected), 1e-10)


def plain_rsi(x, period=14):
    """Wilder's RSI row by row, gain and loss scaled together so that flat runs do not underflow."""
    out, g, l = [np.nan] * min(period, len(x)), 0.0, 0.0
    d = np.diff(x)
    if len(d) >= period:
        g, l = np.maximum(d[:period], 0).mean(), np.maximum(-d[:period], 0).mean()
        out.append(100.0 if l == 0 else 100 - 100 / (1 + g / l))
        for v in d[period:]:
            if v:
                g, l = (g * (period - 1) + max(v, 0)) / period, (l * (period - 1) + max(-v, 0)) / period
            elif g > 1e-250 and l > 1e-250:
                g, l = g * (period - 1) / period, l * (period - 1) / period
            out.append(100.0 if l == 0 else 100 - 100 / (1 + g / l))
    return np.array(out)


@pytest.mark.parametrize("block_rows", [50, 700, 65_536])
def test_recursive_averages_remember_flat_runs(bar_frame, block_rows):
    x = np.concatenate([walk(500), np.full(5000, walk(500)[-1]), walk(700)[500:]]).tolist()
    options = {"slicing": by_time(86_400 * 40), "block_rows": block_rows}
    assert np.allclose(column(I.rsi(bar_frame(x), **options), "RSI_14"), plain_rsi(x), rtol=1e-8, equal_nan=True)
    s = pd.Series(x)
    assert close_to(column(I.ema(bar_frame(x), 200, **options), "EMA_200"), s.ewm(span=200, adjust=False).mean(), 1e-12)
    m = I.macd(bar_frame(x), **options)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert np.allclose(column(m, "macd_signal"), line.ewm(span=9, adjust=False).mean(), atol=1e-10)


@pytest.mark.parametrize("group", [1, 3, 7])
def test_no_task_scans_all_blocks_of_a_symbol(bar_frame, monkeypatch, group):
    """The states of one symbol's 95 blocks are scanned in groups; values do not depend on their size."""
    x = walk(1500)
    s, seen = pd.Series(x), []
    monkeypatch.setattr(ordered, "SCAN_GROUP", group)
    scanned = ordered._scanned

    def noted(sums, keys, *rest):
        size = F.floor(F.col("__block") / group)
        seen.append((sums.groupBy(*keys, size).count().agg(F.max("count")).first()[0], sums.count()))
        return scanned(sums, keys, *rest)

    monkeypatch.setattr(ordered, "_scanned", noted)
    seams = {"slicing": by_time(86_400 * 3), "block_rows": 16}
    out = I.calculate_indicators(bar_frame(x), ["EMA", "MACD", "RSI"], EMA={"period": [5, 200]}, **seams)
    assert seen == [(group, 95)]  # the last one holds halo rows only
    for n in (5, 200):
        assert close_to(column(out, f"EMA_{n}"), s.ewm(span=n, adjust=False).mean(), 1e-13)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert np.allclose(column(out, "macd_signal"), line.ewm(span=9, adjust=False).mean(), atol=1e-11)
    assert np.allclose(column(out, "RSI_14"), plain_rsi(x), rtol=1e-9, equal_nan=True)


def test_merged_blocks_combine_like_the_blocks():
    r = np.random.default_rng(8)
    for i in (I.ema_of([3, 50]), I.macd_of(), I.rsi_of(5)):
        x = np.round(r.normal(size=90).cumsum(), 1)
        x[r.random(90) < 0.1] = np.nan
        frames = [pd.DataFrame({"close": x[a:b], "__own": True, "__pos": np.arange(a + 1, b + 1)}) for a, b in ((0, 30), (30, 31), (31, 90))]
        a, b, c = map(i.summary, frames)
        one_by_one = i.combine(i.combine(i.combine(None, a), b), c)
        for merged in (i.merge(i.merge(a, b), c), i.merge(a, i.merge(b, c))):
            assert np.allclose(i.combine(None, merged), one_by_one, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("seed,holes", [(1, 0.0), (2, 0.02), (3, 0.4)])
def test_sliding_ranks_equal_all_comparisons(seed, holes):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, 260).astype(float)
    x[r.random(260) < holes] = np.nan
    periods = [2, 9, 13, 108, 300]
    found = I.rank_indices(x, periods)
    for n in periods:
        want = np.full(260, np.nan)
        if n <= 260:
            squares = I._rank_squares(np.lib.stride_tricks.sliding_window_view(x, n))
            want[n - 1 :] = (1 - 6 * squares / (n * (n * n - 1))) * 100
        assert np.array_equal(found[n], want, equal_nan=True)


@pytest.mark.parametrize("width", [1, 2, 100])
def test_first_bid_skips_nulls_whatever_the_slices(spark, width):
    rows = [("A", i, b) for i, b in enumerate([None, 2.0, None, 4.0, 8.0])]
    ticks = spark.createDataFrame(rows, "symbol string, seq long, bid double")
    out = {r.seq: r.normalised for r in A.normalised_price(ticks, by_seq(width)).collect()}
    assert out == {0: None, 1: 100.0, 2: None, 3: 200.0, 4: 400.0}


def test_correlation_by_time_is_centred(bar_frame, spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=600), r.normal(size=600)
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(600)]
    closes = {"A": 1e6 + a * 1e-3, "B": 1e6 + (b - a) * 1e-3, "C": np.full(600, 1.1)}
    rows = [(s, t, float(x)) for s, xs in closes.items() for t, x in zip(times, xs)]
    bars = spark.createDataFrame(rows, "symbol string, time timestamp, close double")
    out = {(x.symbol_a, x.symbol_b): x.r for x in A.correlation_by_time(bars, bucket_bars=50, cells=2).collect()}
    true = np.corrcoef(closes["A"], closes["B"])[0, 1]
    assert abs(out["A", "B"] - true) < 1e-6
    assert out["A", "C"] is None and out["B", "C"] is None


def test_indicators_share_one_pass(bar_frame):
    x = walk(300)
    out = I.calculate_indicators(bar_frame(x), ["sma", "bollinger", "ema", "rsi"], period=14, EMA={"period": [5, 9]}, **SEAMS)
    assert {"SMA_14", "bb_upper", "EMA_5", "EMA_9", "RSI_14"} <= set(out.columns)
    assert close_to(column(out, "SMA_14"), pd.Series(x).rolling(14).mean())
    assert close_to(column(out, "EMA_9"), pd.Series(x).ewm(span=9, adjust=False).mean(), 1e-13)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    # four indicators cost no more shuffles than one recursive average; frames alone only number and cut the rows
    assert shuffles(out) == shuffles(I.ema(bar_frame(x), 5, **SEAMS))
    assert shuffles(I.calculate_indicators(bar_frame(x), ["sma", "bollinger"], **SEAMS)) <= 4


def test_rsi_of_short_and_rising_series(bar_frame):
    assert column(I.rsi(bar_frame([1.0] * 10)), "RSI_14").isna().all()
    assert column(I.rsi(bar_frame([1.0 + i for i in range(20)])), "RSI_14")[14:].tolist() == [100.0] * 6


def test_rci(bar_frame):
    x = [1.0, 3.0, 2.0, 5.0, 4.0, 4.0, 7.0, 6.0, 9.0, 8.0] * 8
    out = column(I.rci(bar_frame(x), 9, **SEAMS), "RCI_9")
    for i in range(8, len(x)):
        ranks = pd.Series(x[i - 8 : i + 1]).rank().to_numpy()
        d = np.arange(1, 10) - ranks
        assert np.isclose(out[i], (1 - 6 * (d**2).sum() / (9 * 80)) * 100)
    assert out[:8].isna().all()
    assert column(I.rci(bar_frame(list(range(1, 12))), 9), "RCI_9")[8:].tolist() == [100.0] * 3


def test_unknown_indicator(bar_frame):
    with pytest.raises(ValueError):
        I.calculate_indicators(bar_frame([1.0]), ["WAVES"])
    I.register("last", lambda df: df.withColumn("copy", F.col("close")))
    try:
        assert I.calculate_indicators(bar_frame([1.0]), ["LAST"]).first()["copy"] == 1.0
    finally:
        I.unregister("LAST")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    values = {"A": rng.normal(0, 1, 997), "B": np.repeat([0.5, -0.25, 0.0], [500, 3, 200]), "C": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    out = exact_quantiles(spark.createDataFrame(rows, "symbol string, x double"), ["symbol"], "x", {"q1": 0.25, "m": 0.5, "q9": 0.9})
    for r in out.collect():
        assert np.allclose([r["q1"], r["m"], r["q9"]], np.quantile(values[r["symbol"]], [0.25, 0.5, 0.9]), rtol=1e-12)


def test_correlation_of_the_last_ticks(tick_frame):
    rng = np.random.default_rng(2)
    series = {f"PAIR0{i}": rng.normal(100, 1, 60 + 25 * i) for i in range(5)} | {"SHORT1": rng.normal(1, 1, 50)}
    rows = [(0, v, v + 1, 1.0, name) for name, x in series.items() for v in x]
    out = A.correlation_matrix(tick_frame(rows), cells=3).collect()
    assert len(out) == 10  # SHORT1 has too few ticks
    for r in out:
        a, b = series[r["symbol_a"]][-60:], series[r["symbol_b"]][-60:]
        assert np.isclose(r["r"], np.corrcoef(a, b)[0, 1])


def test_correlation_by_time_in_runs(bar_frame):
    a, b = walk(90, 1), walk(70, 2)
    df = bar_frame(a, "AAAAAA").unionByName(bar_frame(b, "BBBBBB", at=list(range(10, 80))))
    (row,) = A.correlation_by_time(df, bucket_bars=7, cells=2).collect()
    assert row["n"] == 70 and np.isclose(row["r"], np.corrcoef(a[10:80], b)[0, 1])


def test_returns_volatility_and_performance(tick_frame):
    x = walk(120)
    ticks = tick_frame([(i, v, v + 0.01) for i, v in enumerate(x)])
    s = pd.Series(x).pct_change()
    assert np.allclose(column(A.returns(ticks, by_seq(11)), "return", "seq"), s[1:])
    vol = s.rolling(10).std() * np.sqrt(252) * 100
    row = A.volatility_summary(A.rolling_volatility(ticks, 10, by_seq(11), 16)).first()
    assert np.allclose([row["current_vol"], row["avg_vol"], row["max_vol"]], [vol.iloc[-1], vol.mean(), vol.max()])
    assert A.volatility_summary(A.rolling_volatility(ticks.filter("seq < 10"))).count() == 0
    perf = A.performance(ticks, by_seq(11)).first()
    assert np.isclose(perf["volatility"], s.std() * 100) and np.isclose(perf["change"], x[-1] - x[0])
    norm = column(A.normalised_price(ticks, by_seq(11)), "normalised", "seq")
    assert np.allclose(norm, np.array(x) / x[0] * 100)


def test_histogram_covers_every_tick(tick_frame):
    out = A.price_histogram(tick_frame([(i, 1.0 + i) for i in range(31)])).orderBy("bin").collect()
    assert [r["ticks"] for r in out] == [1] * 29 + [2] and out[-1]["bin_end"] == 31.0
    assert A.price_histogram(tick_frame([(0, 5.0), (1, 5.0)])).first()["ticks"] == 2


def test_bar_statistics(bar_frame):
    df = bar_frame([1.0, 2.0, 4.0])
    assert A.first_last_change(df).first()["change_percent"] == 300.0
    assert A.last_change(df).first()["change_percent"] == 100.0
    assert A.trend(df).first()["trend"] == "up" and A.trend(bar_frame([1.0, 1.0])).first()["trend"] == "down"
    assert A.volume_ratio(df).first()["volume_ratio"] == 1.5
    assert A.range_statistics(df).first()["price_range"] == 4.0
    one = A.first_last_change(bar_frame([3.0])).first()
    assert (one["change"], one["change_percent"]) == (0.0, 0.0)


def test_engulfing_patterns(bar_frame):
    df = bar_frame([1.0, 2.5, 0.5], opens=[2.0, 0.9, 2.6])
    found = A.candle_patterns(df, by_time(3600)).orderBy("time").collect()
    assert [r["pattern"] for r in found] == ["Bullish Engulfing", "Bearish Engulfing"]
    assert [r["pattern"] for r in A.recent_patterns(df, 2).collect()] == ["Bearish Engulfing"]


# --- gaps ----------------------------------------------------------------------


def test_hole_in_hourly_history(bar_frame):
    hours = [h for h in range(100) if not 50 <= h < 60]
    for slicing in (None, by_time(7200), by_time(86_400 * 30)):
        (hole,) = G.detect_missing_periods(bar_frame([1.0] * 90, at=hours), "H1", slicing=slicing).collect()
        assert hole["expected_bars"] == 11 and hole["gap_seconds"] == 11 * 3600
    bars = bar_frame([1.0] * 90, at=hours)
    rate = G.missing_rate(bars, G.detect_missing_periods(bars, "H1")).first()
    assert np.isclose(rate["missing_rate"], 11 / 101 * 100)


@pytest.mark.parametrize(("minutes", "gap"), [(89, False), (90, False), (91, True), (120, True)])
def test_gap_rule(bar_frame, minutes, gap):
    bars = bar_frame([1.0, 1.0], step=60, at=[0, minutes])
    assert (G.detect_missing_periods(bars, "H1").count() == 1) is gap


def test_market_closed_equals_day_stepping(spark):
    rng = np.random.default_rng(8)
    base = dt.datetime(2023, 12, 20)
    rows = []
    for _ in range(600):
        a = base + dt.timedelta(seconds=int(rng.integers(0, 40 * 86_400)))
        rows.append((a, a + dt.timedelta(seconds=int(rng.choice([0, 600, 40_000, 90_000, 300_000, 900_000])))))
    fixed = [
        (dt.datetime(2024, 1, 5, 23), dt.datetime(2024, 1, 6, 1)),  # Friday night into Saturday: not closed
        (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 6, 1)),
        (dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 7, 1)),
        (dt.datetime(2024, 12, 25, 3), dt.datetime(2024, 12, 25, 4)),
        (dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 4)),
        (dt.datetime(2024, 1, 8, 3), dt.datetime(2024, 1, 8, 4)),
    ]

    def stepping(a, b):
        day = a
        while day <= b:
            if day.weekday() >= 5:
                return True
            day += dt.timedelta(days=1)
        return any((x.month, x.day) in ((12, 25), (1, 1)) for x in (a, b))

    rows = fixed + rows
    df = spark.createDataFrame(
        [(i, a.replace(tzinfo=UTC), b.replace(tzinfo=UTC)) for i, (a, b) in enumerate(rows)], "i int, a timestamp, b timestamp"
    )
    out = df.select("i", G.market_closed(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in out] == [stepping(a, b) for a, b in rows]
    assert [r["c"] for r in out[:6]] == [False, True, True, True, True, False]


@pytest.mark.parametrize("method", ["forward", "backward", "linear"])
def test_fill_gaps(bar_frame, method):
    at = [0, 1, 4, 5, 80]
    x = [1.0, 2.0, 5.0, 6.0, 9.0]
    out = G.fill_gaps(bar_frame(x, at=at), "H1", method, slicing=by_time(7200)).orderBy("time").collect()
    s = pd.Series(x, index=at).reindex(range(81))
    expected = {"forward": s.ffill(), "backward": s.bfill(), "linear": s.interpolate()}[method]
    assert np.allclose([r["close"] for r in out], expected)
    assert [r["is_filled"] for r in out] == s.isna().tolist()


def test_fill_gaps_with_bars_longer_than_a_day(bar_frame):
    out = G.fill_gaps(bar_frame([1.0, 4.0], step=7 * 86_400, at=[0, 3]), "W1", "linear").orderBy("time").collect()
    assert [r["close"] for r in out] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        G.fill_gaps(bar_frame([1.0]), "H1", "spline")


def test_gap_classes_and_quality(bar_frame):
    # Friday 20:00 → Monday 03:00 weekend; Monday 22:00 → Tuesday 05:00 night; Tuesday 08:00 → 14:00 data
    friday = dt.datetime(2024, 1, 12, 19, tzinfo=UTC)
    at = [0, 1, 56, *range(57, 76), 82, 83, 84, 85, 91]
    bars = bar_frame([1.0] * len(at), at=at, start=friday)
    classed = G.classify_gaps(bars, "H1")
    assert [r["gap_class"] for r in classed.orderBy("start").collect()] == ["weekend", "market_closed", "data_gap"]
    score = G.quality_score(bars, classed, "H1").first()
    assert (score["data_gaps"], score["quality_score"], score["rating"]) == (1, 90, "Excellent")
    days = {str(r["day"]): r["coverage"] for r in G.day_coverage(classed).collect()}
    assert days == {"2024-01-12": "Weekend", "2024-01-15": "Normal", "2024-01-16": "Data Gap"}
    numbers = G.interval_statistics(bars, "H1").first()
    assert (numbers["min_seconds"], numbers["median_seconds"], numbers["max_seconds"]) == (3600.0, 3600.0, 55 * 3600.0)


# --- reconciliation and alerts ---------------------------------------------------


def test_reconciliation(tick_frame):
    ticks = tick_frame([(60 * i, 1.0 + i / 1000) for i in range(4)])
    mine = B.tick_bars(ticks, "M1")
    theirs = B.broker_bars(ticks.filter("seq < 3").withColumn("bid", F.when(F.col("seq") == 1, F.col("bid") + 0.001).otherwise(F.col("bid"))), "M1")
    out = J.compare_bars(mine, theirs).orderBy("time").collect()
    assert [r["match"] for r in out] == [True, False, True, False]
    assert out[3]["reason"] == "No MT5 bar found" and np.isclose(out[1]["accuracy"], 60.0)
    total = J.reconciliation_summary(J.compare_bars(mine, theirs)).first()
    assert (total["compared"], total["matches"]) == (3, 2)


def test_timeframe_consistency(tick_frame):
    ticks = tick_frame([(60 * i, 1.0 + i) for i in range(10)])
    fine = B.tick_bars(ticks, "M1").filter(F.col("time") != "2025-01-20 10:07:00")
    out = J.timeframe_consistency(fine, B.tick_bars(ticks, "M5")).orderBy("time").collect()
    assert [(r["is_full"], r["price_consistent"]) for r in out] == [(True, True), (False, None)]


def predictions(spark, rows):
    return spark.createDataFrame(
        [(s, START + dt.timedelta(minutes=m), START + dt.timedelta(hours=9), k, 1.0, c) for s, m, k, c in rows],
        "symbol string, predicted_at timestamp, target_timestamp timestamp, prediction_type string, predicted_value double, confidence_score double",
    )


def test_confidence_alert(spark):
    out = M.confidence_alerts(predictions(spark, [("GBPUSD", 0, "DIRECTION", 0.85), ("GBPUSD", 1, "PRICE", 0.79)])).collect()
    assert len(out) == 1 and out[0]["severity"] == "WARNING"
    assert out[0]["message"] == "High confidence DIRECTION prediction"


@pytest.mark.parametrize("width", [600, 86_400])
def test_momentum_alerts_take_the_next_prediction(bar_frame, spark, width):
    bars = bar_frame([2.0, 1.0, 2.0, 2.0], "AUDUSD", opens=[1.0, 2.0, 1.0, 1.0])
    ahead = predictions(spark, [("AUDUSD", 0, "DIRECTION", 0.9), ("AUDUSD", 30, "PRICE", 0.99), ("AUDUSD", 125, "DIRECTION", 0.5), ("OTHERS", 300, "DIRECTION", 0.9)])
    out = M.momentum_alerts(bars, ahead, slicing=by_time(width, "at")).orderBy("bar_time").collect()
    assert [r["severity"] for r in out] == ["CRITICAL", "WARNING"]
    assert [r["bar_time"].hour for r in out] == [0, 2]


def test_price_threshold_alerts(tick_frame, spark):
    ticks = tick_frame([(i, 1.0 + i) for i in range(5)])
    rules = spark.createDataFrame([("EURUSD", 3.0, "CRITICAL"), ("GBPUSD", 0.0, "INFO")], "symbol string, threshold double, severity string")
    out = M.price_threshold_alerts(ticks, rules).collect()
    assert sorted(r["current_value"] for r in out) == [4.0, 5.0]
    assert {r["severity"] for r in out} == {"CRITICAL"}


def test_forecasts(bar_frame):
    bars = bar_frame([100.0, 101.0, 102.0])
    (last,) = M.naive_forecasts(M.latest_bars(bars)).collect()
    assert np.isclose(last["predicted_value"], 102 * 1.001, rtol=1e-6) and last["confidence_score"] == 0.75
    row = M.evaluate_forecasts(M.naive_forecasts(bars, 3600), bars).first()
    assert M.evaluate_forecasts(M.naive_forecasts(bars, 3600), bars, metrics=["rmse"]).columns == ["symbol", "pairs", "rmse"]
    for bad in (["mse"], []):
        with pytest.raises(ValueError):
            M.evaluate_forecasts(M.naive_forecasts(bars, 3600), bars, metrics=bad)
    errors = np.array([100 * 1.001 - 101, 101 * 1.001 - 102])
    assert np.isclose(row["mae"], np.abs(errors).mean(), rtol=1e-4)
    assert np.isclose(row["rmse"], np.sqrt((errors**2).mean()), rtol=1e-4)
    assert row["pairs"] == 2 and np.isclose(row["mape"], (np.abs(errors) / [101, 102]).mean() * 100, rtol=1e-4)


def test_correlation_of_many_symbols_sends_a_vector_to_few_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL_SYMBOLS", 2)
    monkeypatch.setattr(A, "MATRIX_PARTS", 3)
    monkeypatch.setattr(A, "MATRIX_ROWS", 4)  # a cell is handed over in several pieces
    rng = np.random.default_rng(5)
    series = {f"Y{i:02d}": rng.normal(100, 1, 6) for i in range(22)} | {"Y99": np.full(6, 2.5)}
    rows = [(name, i, float(v)) for name, x in series.items() for i, v in enumerate(x)]
    out = A.correlation_matrix(spark.createDataFrame(rows, "symbol string, seq long, bid double"), more_than=3, last=5)
    assert out.rdd.getNumPartitions() == 6  # 11 parts of two symbols would be 66 cells
    got = {(r.symbol_a, r.symbol_b): r.r for r in out.collect()}
    assert set(got) == {(a, b) for a in series for b in series if a < b} and len(got) == out.count()
    for (a, b), r in got.items():
        want = None if "Y99" in (a, b) else np.corrcoef(series[a][-5:], series[b][-5:])[0, 1]
        assert r is None if want is None else np.isclose(r, want)


def test_looking_ahead_runs_along_the_rows_once(spark):
    """A frame up to the end is computed anew for each row: the work grew with the square of a slice."""
    from tickloom.operators.ordered import nearest

    rows = [("A", at, at if at % 4 == 0 else None) for at in range(23)] + [("B", 3, None), ("A", None, 99)]
    df = spark.createDataFrame(rows, "symbol string, seq long, x long")
    out = nearest(df, ["symbol"], by_seq(5), F.col("x"), "hit", "forward")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {(r.symbol, r.seq): r.hit for r in out.collect()}
    assert got.pop(("A", None)) == 99 and got.pop(("B", 3)) is None
    assert got == {("A", at): (at + 3) // 4 * 4 if at <= 20 else None for at in range(23)}


def test_correlation_shuffles_no_copies_of_vectors(spark, monkeypatch):
    """Each vector went to 16 cells through a shuffle, some five times the input on disk; ranks were shuffled twice."""
    from tickloom.operators.ordered import last_rows

    monkeypatch.setattr(A, "CELL_SYMBOLS", 3)
    rng = np.random.default_rng(8)
    series = {f"Z{i:02d}": rng.normal(100, 1, 6) for i in range(20)}
    rows = [(name, i, float(v)) for name, x in (series | {None: series["Z00"]}).items() for i, v in enumerate(x)]
    ticks = spark.createDataFrame(rows, "symbol string, seq long, bid double")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(last_rows(ticks, ["symbol"], "seq", 5)) == 1
    out = A.correlation_matrix(ticks, more_than=3, last=5)
    assert exchanges(out) == 0
    got = {(r.symbol_a, r.symbol_b): r.r for r in out.collect()}
    # a symbol without a name is in no pair: it is neither before nor behind another one
    assert set(got) == {(a, b) for a in series for b in series if a < b} and len(got) == out.count()
    assert all(np.isclose(r, np.corrcoef(series[a][-5:], series[b][-5:])[0, 1]) for (a, b), r in got.items())
