from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import clean as C
from tickloom.operators import spikes as S
from tickloom.operators.ordered import (
    by_seq,
    by_time,
    equal_depth,
    last_rows,
    measured,
    nearest,
    neighbours,
    running,
    with_position,
)
from tickloom.operators.rolling import moments_before, moments_up_to


def fold_spikes(rows, threshold, gap):
    """The filter as one reader would run it: rows are (seconds, bid, ask)."""
    good, out = None, []
    for t, b, a in rows:
        if good is None or t - good[0] > gap:
            good = (t, b, a)
            out.append(False)
            continue
        moved = max(abs((b - good[1]) / good[1]) * 100, abs((a - good[2]) / good[2]) * 100)
        out.append(moved > threshold)
        if not out[-1]:
            good = (t, b, a)
    return out


def noisy(n, seed, jump=0.3, pause=0.02):
    rng = random.Random(seed)
    t, p, rows = 0, 100.0, []
    for _ in range(n):
        t += rng.choice([1, 2, 5]) if rng.random() > pause else 400
        p *= 1 + rng.uniform(-0.0004, 0.0004)
        shown = p * (1 + rng.choice([0.01, -0.02, 0.5])) if rng.random() < jump else p
        rows.append((t, round(shown, 5), round(shown + 0.01, 5)))
    return rows


def flags(df):
    return [r["is_spike"] for r in df.orderBy("seq").select("is_spike").collect()]


def test_known_spike(tick_frame):
    ticks = tick_frame([(0, 171.500, 171.510), (1, 171.498, 171.508), (2, 171.700, 171.710)])
    assert flags(C.flag_spikes(ticks)) == [False, False, True]


@pytest.mark.parametrize("width", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("jump", [0.02, 0.4])
def test_spikes_equal_the_fold_however_sliced(tick_frame, width, jump):
    rows = noisy({1: 15, 7: 120}.get(width, 600), 11, jump)
    expected = fold_spikes(rows, 0.1, 300)
    assert any(expected)
    assert flags(C.flag_spikes(tick_frame(rows), slicing=by_seq(width))) == expected


def test_lasting_level_shift_locks_out_over_many_slices(tick_frame):
    rows = [(i, 100.0, 100.01) for i in range(20)] + [(20 + i, 101.0, 101.01) for i in range(400)]
    expected = fold_spikes(rows, 0.1, 300)
    assert sum(expected) == 300
    assert flags(C.flag_spikes(tick_frame(rows), slicing=by_seq(64))) == expected


def test_two_levels_that_never_agree(tick_frame):
    rows = [(i, 100.0 if i % 2 else 105.0, 106.0) for i in range(60)]
    assert flags(C.flag_spikes(tick_frame(rows), slicing=by_seq(8))) == fold_spikes(rows, 0.1, 300)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.sampled_from([100.0, 100.05, 100.2, 150.0])), min_size=1, max_size=60))
def test_walk_equals_the_fold(steps):
    t = np.cumsum([s for s, _ in steps]).astype("int64") * 1_000_000
    bid = np.array([p for _, p in steps])
    spike, _ = C.walk_spikes(t, bid, bid + 0.01, None, 0.1, 300.0)
    assert spike.tolist() == fold_spikes([(x / 1e6, b, b + 0.01) for x, b in zip(t, bid)], 0.1, 300)


@pytest.mark.parametrize("slices", [4, 16, 64])
def test_rounds_grow_with_the_logarithm_of_the_slices(tick_frame, slices):
    """Two price levels that never agree, less than the market gap apart: every slice is in doubt."""
    rows = [(i, 100.0 if i % 2 else 105.0, 106.0) for i in range(8 * slices)]
    runs = tick_frame(rows).withColumn("__slice", by_seq(8).column())
    carried, rounds = S._Filter(runs, 0.1, 10_000.0).carried()
    assert rounds <= np.log2(slices) + 1
    assert {r.carried.bid for r in carried.filter("__slice > 0").collect()} == {105.0}


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.tuples(st.integers(-20, 200), st.sampled_from([100.0, 100.05, 100.2, 101.0, 150.0])), min_size=1, max_size=80),
    st.integers(1, 12),
)
def test_maps_compose_to_the_fold(steps, width):
    """Slice rows and maps alone give the tick carried into every slice; times may go back."""
    t = np.cumsum([s for s, _ in steps]).astype("int64") * 1_000_000
    bid = np.array([p for _, p in steps])
    runs = [S.Run(t[i : i + width], bid[i : i + width], bid[i : i + width] + 0.01, 0.1, 300.0) for i in range(0, len(t), width)]
    shown = lambda x: S._shown(x)
    facts = [
        dict(first=shown(r.tick(0)), free=shown(r.transfer(None)), ends=[shown(x) for x in r.ends()], ts_high=int(r.ts.max()),
             bid_low=r.bid.min(), bid_high=r.bid.max(), ask_low=r.ask.min(), ask_high=r.ask.max())
        for r in runs
    ]
    moves = [[] for _ in runs]
    for rounds in range(60):
        rows = [S.SliceRow(f, m, 0.1, 300.0) for f, m in zip(facts, moves)]
        carried, asked = S.scan(rows, 1 << rounds)
        if not asked:
            break
        for k, states in asked.items():
            moves[k] += [{"before": shown(s), "after": shown(runs[k].transfer(s))} for s in states]
    got = np.concatenate([r.flags(c) for r, c in zip(runs, carried, strict=True)])
    assert got.tolist() == fold_spikes([(x / 1e6, b, b + 0.01) for x, b in zip(t, bid)], 0.1, 300)
    for r in runs:  # whatever comes in, what goes out is an end or what came in
        assert {r.transfer(s) for s in [(int(t[0]), 99.0, 99.01), (int(t[-1]), 150.0, 150.01)]} <= {*r.ends(), (int(t[0]), 99.0, 99.01), (int(t[-1]), 150.0, 150.01)}


def test_a_future_tick_that_locks_out_settles_without_reading_ticks(tick_frame):
    rows = [(0, 100.0), (10_000_000, 300.0), *[(10 + i, 100.0) for i in range(200)]]
    runs = tick_frame(rows).withColumn("__slice", by_seq(4).column())
    carried, rounds = S._Filter(runs, 0.1, 300.0).carried()
    assert rounds <= 1 and {r.carried.bid for r in carried.filter("__slice > 0").collect()} == {300.0}
    assert flags(C.flag_spikes(tick_frame(rows), slicing=by_seq(4))) == fold_spikes([(t, b, b + 0.0002) for t, b in rows], 0.1, 300)


def test_bad_settings(tick_frame):
    with pytest.raises(ValueError):
        C.flag_spikes(tick_frame([(0, 1.0)]), threshold_percent=0)


@pytest.mark.parametrize("width", [1, 13, 1 << 20])
def test_reversals_and_gaps_equal_the_fold(tick_frame, width):
    rng = random.Random(5)
    times = [i * 10 + rng.randint(-40, 40) + (500 if i > 150 else 0) + 1000 for i in range(300)]
    last, late, holes = None, [], []
    for t in times:
        if last is not None and t < last:
            late.append(t)
            continue
        if last is not None and t - last > 30:
            holes.append(float(t - last))
        last = t
    ticks = tick_frame([(t, 1.0) for t in times])
    assert C.rejected_ticks(ticks, by_seq(width)).count() == len(late)
    found = C.tick_gaps(ticks, 30, by_seq(width)).orderBy("ts").collect()
    assert [g["gap_seconds"] for g in found] == holes


def test_gap_of_thirty_five_seconds(tick_frame):
    (gap,) = C.tick_gaps(tick_frame([(0, 1.0), (35, 1.0), (65, 1.0)])).collect()
    assert gap["gap_seconds"] == 35.0 and gap["threshold"] == 30.0


def test_moments_match_numpy():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(100, 1e-3, 500), np.full(300, 7.25), rng.normal(0, 1e4, 321)])
    for n in (1, 2, 7, 100, 2000):
        count, mean, std = moments_up_to(x, n)
        for i in list(range(0, len(x), 37)) + [len(x) - 1]:
            w = x[max(0, i - n + 1) : i + 1]
            assert count[i] == len(w)
            assert np.isclose(mean[i], w.mean(), rtol=1e-12)
            assert np.isclose(std[i], w.std(ddof=1) if len(w) > 1 else 0.0, rtol=1e-9, atol=0)
    assert (moments_up_to(np.full(500, 1.1), 100)[2] == 0).all()
    count, mean, _ = moments_before(x, 5)
    assert count[0] == 0 and mean[1] == x[0]


@pytest.mark.parametrize("n", [5, 100])
def test_rolling_statistics_cross_blocks(tick_frame, n):
    rows = noisy(700, 2, 0.0)
    out = C.rolling_mean_std(tick_frame(rows), n, by_seq(90), block_rows=128).orderBy("seq").toPandas()
    bid = pd.Series([b for _, b, _ in rows])
    assert np.allclose(out["bid_mean"], bid.rolling(n, min_periods=1).mean(), rtol=1e-12)
    assert np.allclose(out["bid_std"], bid.rolling(n, min_periods=1).std().fillna(0), rtol=1e-6)


def test_zscore_flags(tick_frame):
    rows = [(i, 100.0 + (i % 5) * 0.01) for i in range(300)]
    rows[50], rows[250] = (50, 120.0), (250, 120.0)
    out = C.zscore_flags(tick_frame(rows), 3.0, 60, 55, by_seq(40), 64).orderBy("seq").toPandas()
    x = pd.Series([b for _, b in rows])
    mean, std = x.rolling(60, min_periods=1).mean().shift(), x.rolling(60, min_periods=2).std().shift()
    expected = ((x - mean).abs() / std).fillna(0)
    assert np.allclose(out["bid_z"], expected, rtol=1e-6)
    assert not out["is_spike"][50] and out["is_spike"][250]  # warm-up, then flagged


def test_trailing_rate_counts_the_open_window(tick_frame):
    times = [0, 1, 1, 9, 10, 11, 3599, 3600, 3605, 3609, 3610, 8000]
    out = C.trailing_rate(tick_frame([(t, 1.0) for t in times]), 10, 10.0, "rate").orderBy("seq").collect()
    expected = [sum(1 for u in times if 0 <= t - u < 10) / 10 for t in times]
    assert [r["rate"] for r in out] == expected


def test_latency_summary(tick_frame, spark):
    ticks = tick_frame([(i, 1.0, 1.1, float(i)) for i in range(150)]).withColumnRenamed("volume", "latency_ms")
    row = C.latency_summary(ticks).first()
    assert (row["avg"], row["p95"], row["max"]) == (99.5, 145.0, 149.0)


def test_counters(tick_frame):
    flagged = C.flag_spikes(tick_frame([(0, 100.0), (1, 200.0), (2, 100.0), (3, 100.01)]))
    row = C.counters(flagged).first()
    assert (row["total_ticks"], row["spike_count"], row["spike_percent"]) == (4, 1, 25.0)


# --- ordered primitives ------------------------------------------------------


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_ordered_primitives_ignore_the_slicing(spark, width):
    data = pd.DataFrame({"symbol": ["A"] * 50 + ["B"] * 7, "seq": [i * 2 for i in range(57)]})
    data["x"] = [(i * 37) % 19 / 2 for i in range(57)]
    df = spark.createDataFrame(data)
    cut = by_seq(width)
    near = neighbours(df, ["symbol"], cut, prev={"before": "x"}, next={"after": "x"}).toPandas().sort_values("seq")
    groups = data.groupby("symbol")["x"]
    assert near["before"].fillna(-1).tolist() == groups.shift(1).fillna(-1).tolist()
    assert near["after"].fillna(-1).tolist() == groups.shift(-1).fillna(-1).tolist()
    folds = {"top": ("max", F.col("x")), "total": ("sum", F.col("x")), "base": ("first", F.col("x"))}
    run = running(df, ["symbol"], cut, folds).toPandas().sort_values("seq")
    assert run["base"].tolist() == groups.transform("first").tolist()
    assert run["top"].tolist() == groups.cummax().tolist()
    assert np.allclose(run["total"], groups.cumsum())
    spot = with_position(df, ["symbol"], cut).toPandas().sort_values("seq")
    assert spot["position"].tolist() == (data.groupby("symbol").cumcount() + 1).tolist()


@pytest.mark.parametrize("width", [1, 5, 1000])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_nearest(spark, width, direction):
    data = pd.DataFrame({"symbol": "A", "seq": range(40)})
    data["hit"] = [float(i) if i % 7 == 3 else None for i in range(40)]
    out = nearest(spark.createDataFrame(data), ["symbol"], by_seq(width), F.col("hit"), "found", direction)
    out = out.toPandas().sort_values("seq")["found"]
    expected = data["hit"].bfill() if direction == "forward" else data["hit"].ffill()
    assert out.fillna(-1).tolist() == expected.fillna(-1).tolist()


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_unusable_quotes_are_spikes(spark, width):
    bids = [1.0, 0.0, 1.0001, float("nan"), None, -1.0, 1.0002, 2.0, 1.0003]
    rows = [("EURUSD", i, i, b, None if b is None else b + 0.0001) for i, b in enumerate(bids)]
    ticks = spark.createDataFrame(rows, "symbol string, sec long, seq long, bid double, ask double")
    ticks = ticks.select("symbol", F.timestamp_seconds("sec").alias("ts"), "seq", "bid", "ask")
    flagged = C.flag_spikes(ticks, 0.1, slicing=by_seq(width)).collect()
    assert {r.seq for r in flagged if not r.is_spike} == {0, 2, 6, 8} and len(flagged) == len(bids)
    nameless = ticks.withColumn("symbol", F.lit(None).cast("string"))
    assert C.flag_spikes(nameless, 0.1, slicing=by_seq(width)).count() == len(bids)


@pytest.mark.parametrize("n", [1, 150, 1500])
def test_last_rows_of_any_number(spark, n):
    df = spark.range(5000).select(F.when(F.col("id") % 5 < 4, "hot").when(F.col("id") % 2 == 0, "b").alias("symbol"), F.col("id").alias("seq"))
    out = last_rows(df, ["symbol"], "seq", n, "back", slicing=by_seq(64)).collect()
    again = last_rows(df, ["symbol"], "seq", n, "back").collect()
    for rows in (out, again):
        got = {}
        for r in rows:
            got.setdefault(r.symbol, {})[r.back] = r.seq
        for symbol, ranks in got.items():
            mine = [i for i in range(4999, -1, -1) if ("hot" if i % 5 < 4 else "b" if i % 2 == 0 else None) == symbol][:n]
            assert [ranks[k] for k in sorted(ranks)] == mine
    assert len(out) == len(again) and len({r.symbol for r in out}) == 3


def test_last_rows(spark):
    df = spark.range(1000).select(F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"), F.col("id").alias("seq"))
    out = last_rows(df, ["symbol"], "seq", 4, "back").orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(988, 1000))
    assert [r["back"] for r in out][-3:] == [1, 1, 1]


def test_time_slices_hold_neighbours(tick_frame):
    ticks = tick_frame([(i * 1000, float(i + 1)) for i in range(20)])
    near = neighbours(ticks, ["symbol"], by_time(1500, "ts"), prev={"before": "bid"}).orderBy("seq").collect()
    assert [r["before"] for r in near] == [None] + [float(i) for i in range(1, 20)]


def bursty(spark, n=4000):
    """Nine of ten ticks of A within a hundredth of its time; B is even, C is short, one symbol is missing."""
    r = np.random.default_rng(3)
    quiet, burst = r.integers(0, 10_000_000, n // 10), r.integers(5_000_000, 5_100_000, n - n // 10)
    rows = [("A", int(t)) for t in np.unique(np.concatenate([quiet, burst]))]
    rows += [("B", i * 5000) for i in range(n // 2)] + [("C", 7), ("C", 9), (None, 1), (None, 2)]
    return spark.createDataFrame([(s, t, float(t % 97)) for s, t in rows], "symbol string, seq long, bid double")


def test_equal_slices_of_a_burst(spark):
    ticks = bursty(spark).cache()
    for width in (64, 250):
        cut = equal_depth(ticks, "seq", width)
        held = cut.cut(ticks).groupBy("symbol", "__slice").count().collect()
        assert max(r["count"] for r in held) <= 2 * width
        assert {r["__slice"] for r in held if r.symbol in ("C", None)} == {0}
        alone = ticks.filter("symbol = 'A'")
        fixed = measured(alone, "seq", width).cut(alone).groupBy("symbol", "__slice").count()
        assert fixed.agg(F.max("count")).first()[0] > 8 * width  # what average density gives
        order = cut.cut(ticks).groupBy("symbol", "__slice").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        ranges = sorted((r.symbol or "", r["__slice"], r.lo, r.hi) for r in order.collect())
        assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:]) if a[0] == b[0])


def test_equal_slices_give_the_same_results(spark):
    ticks = bursty(spark, 1000)
    cut = equal_depth(ticks, "seq", 40)
    for one, two in [
        (neighbours(ticks, ["symbol"], cut, {"before": "bid"}, {"after": "bid"}), neighbours(ticks, ["symbol"], by_seq(1 << 40), {"before": "bid"}, {"after": "bid"})),
        (with_position(ticks, ["symbol"], cut), with_position(ticks, ["symbol"], by_seq(1 << 40))),
    ]:
        assert sorted(map(tuple, one.fillna("", "symbol").fillna(-1.0).collect())) == sorted(map(tuple, two.fillna("", "symbol").fillna(-1.0).collect()))
    few = equal_depth(ticks.limit(5), "seq", 40)
    assert few.most == 0 and with_position(ticks.limit(5), ["symbol"], few).count() == 5


def test_spikes_in_equal_slices(tick_frame):
    rows = noisy(500, 7, 0.3)
    ticks = tick_frame(rows)
    assert flags(C.flag_spikes(ticks, slicing=equal_depth(ticks, "seq", 30))) == fold_spikes(rows, 0.1, 300)


def test_light_symbols_of_one_counter_are_single_slices(tick_frame, monkeypatch):
    """Numbers a million apart: slices of fixed width held one tick each, and all of them were scanned."""
    rows = {s: noisy(40, i, 0.3) for i, s in enumerate("ABC")}
    ticks = tick_frame([(t, b, a, 1.0, s) for at in zip(*rows.values()) for s, (t, b, a) in zip(rows, at)])
    monkeypatch.setattr(S._Filter, "carried", lambda self: pytest.fail("slices of light symbols were scanned"))
    flagged = C.flag_spikes(ticks.withColumn("seq", F.col("seq") * (1 << 20)))
    for s in rows:
        assert flags(flagged.filter(F.col("symbol") == s)) == fold_spikes(rows[s], 0.1, 300)


def test_measured_slices_follow_the_density(spark):
    sparse = spark.range(1000).select((F.col("id") * 1_000_000).alias("seq"))
    assert 9_900_000 <= measured(sparse, "seq", 10).width <= 10_000_000
    assert measured(sparse.limit(0), "seq", 10).width == 10


def test_a_tick_that_passes_many_slices_takes_one_round(tick_frame):
    """Slices with prices on both sides of the carried tick, none near it: each took a round of its own."""
    prices = [100.0] + [50.0, 200.0] * 20 + [101.0]
    ticks = tick_frame([(i, p) for i, p in enumerate(prices)])
    runs = by_seq(4).cut(ticks).select("symbol", "__slice", "ts", "seq", "bid", "ask")
    # the first slice holds the first tick; what it hands over is one of its ends
    carried, rounds = S._Filter(runs, 10.0, 10_000.0).carried()
    assert rounds <= 1 and {r.carried.bid for r in carried.filter("__slice > 0").collect()} == {100.0}


def test_light_symbols_share_the_rows_that_are_looked_at_together():
    import pyarrow as pa

    names = ["A", "A", "B", "C", "C", "C", None, None]
    table = pa.table({"symbol": names, "__slice": pa.array([0, 1, 1, 1, 1, None, None, None], pa.int64())})
    ((whole, bounds),) = S._whole_groups(table.to_batches(max_chunksize=3), ["symbol", "__slice"])
    assert whole.num_rows == 8 and bounds == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6), (6, 8)]


def test_light_slices_in_doubt_are_settled_where_they_are_summarised(tick_frame):
    """Two price levels that never agree, in light slices: each round read all ticks anew."""
    rows = [(i, 100.0 if i % 2 else 105.0, 106.0) for i in range(512)]
    runs = by_seq(7).cut(tick_frame(rows)).select("symbol", "__slice", "ts", "seq", "bid", "ask")
    carried, rounds = S._Filter(runs, 0.1, 10_000.0).carried()
    assert rounds == 0 and {r.carried.bid for r in carried.filter("__slice > 0").collect()} == {105.0}


@pytest.mark.parametrize("heads, edge, chunk", [(1, 1, 1), (1, 3, 64), (2, 40, 1 << 15)])
def test_what_heads_do_not_tell_is_asked_or_followed(tick_frame, monkeypatch, heads, edge, chunk):
    for name, value in {"HEADS": heads, "EDGE_HEADS": edge, "CHUNK_ROWS": chunk, "PASSING": 2, "LOOK": 1}.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(chunk)
    # times that go back, prices of which few agree, quotes that cannot be used
    prices = [100.0, 100.05, 100.2, 101.0, 150.0, 150.1, 0.0]
    rows = [(rng.choice([0, 0, 5000]) + i * rng.choice([1, 1, 3]), rng.choice(prices)) for i in range(400)]
    ticks = tick_frame(rows)
    usable = [(t, b, b + 0.0002) for t, b in rows if b > 0]
    for cut in (by_seq(7), equal_depth(ticks, "seq", 20)):
        out = C.flag_spikes(ticks, 0.1, 300.0, slicing=cut).orderBy("seq").collect()
        assert [r.is_spike for r in out if r.bid > 0] == fold_spikes(usable, 0.1, 300)
        assert all(r.is_spike for r in out if r.bid == 0)


@pytest.mark.parametrize("look", [1, 3, 32])
def test_runs_of_a_table_are_walked_apart(monkeypatch, look):
    monkeypatch.setattr(S, "LOOK", look)
    rng = np.random.default_rng(look)
    t = np.cumsum(rng.integers(-20, 120, 300)) * 1_000_000
    bid = rng.choice([100.0, 100.05, 100.2, 101.0, 150.0], 300)
    stops = np.array([0, 1, 40, 40, 41, 200, 300])
    together = S.Run(t, bid, bid + 0.01, 0.1, 300.0, stops)
    for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops)):
        alone = S.Run(t[a:b], bid[a:b], bid[a:b] + 0.01, 0.1, 300.0)
        assert together.ends(k) == alone.ends()
        for state in (None, (0, 100.1, 100.11), (int(t[150]), 77.0, 77.01), (int(t.max()), 150.0, 150.01)):
            assert together.transfer(state, k) == alone.transfer(state)
            assert together.flags(state, k).tolist() == alone.flags(state).tolist()
            rows = [(x / 1e6, p, p + 0.01) for x, p in zip(t[a:b], bid[a:b])]
            before = [] if state is None else [(state[0] / 1e6, *state[1:])]
            assert alone.flags(state).tolist() == fold_spikes([*before, *rows], 0.1, 300)[len(before) :]


def test_the_cuts_of_many_slices_are_one_literal(spark, monkeypatch):
    """Each cut was a call of its own: some 2 ms for each of up to 4,096."""
    import pyspark.sql.functions.builtin as B

    calls, real = [], B.lit
    monkeypatch.setattr(B, "lit", lambda x: calls.append(x) or real(x))
    cut = equal_depth(spark.range(2000).select(F.lit("A").alias("symbol"), F.col("id").alias("seq")), "seq", 10)
    assert cut.most == 199 and len(calls) < 100
