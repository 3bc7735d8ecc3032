"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators import bars as B
from tickloom.operators import clean as C
from tickloom.streaming import bars as W
from tickloom.streaming import feed as feeds
from tickloom.streaming import sinks
from tickloom.streaming import stateful as X

UTC = dt.timezone.utc
START = dt.datetime(2025, 8, 21, 12, tzinfo=UTC)


def feed(spark, path, rows, parts):
    """Write ticks as numbered files; one file is one micro-batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        spark.createDataFrame(chunk, S.ARRIVED_TICK).coalesce(1).write.mode("append").parquet(str(path))
    return W.read_ticks(spark, str(path), files_per_trigger=1)


def ticks_of(symbol, times, prices, first=0):
    return [
        (symbol, START + dt.timedelta(seconds=t), first + i, p, p + 0.0002, 1.0)
        for i, (t, p) in enumerate(zip(times, prices))
    ]


def test_five_bars_from_five_minutes(spark, tmp_path):
    rows = ticks_of("EURUSD", range(301), [1.1234 + (i % 10) / 10000 for i in range(301)])
    stream = W.windowed_bars(feed(spark, tmp_path / "in", rows, 3), 60, delay="0 seconds")
    out = sinks.drain(stream, str(tmp_path / "run")).orderBy("time").collect()
    assert [(b["tick_count"], b["volume"]) for b in out] == [(60, 60.0)] * 5


def test_update_mode_shows_the_current_bar(spark, tmp_path):
    rows = ticks_of("EURUSD", range(90), [1.0 + i for i in range(90)])
    stream = W.windowed_bars(feed(spark, tmp_path / "in", rows, 3), 60, delay="0 seconds")
    out = sinks.drain_updates(stream, str(tmp_path / "run"), ["symbol", "time"]).orderBy("time").collect()
    assert [(b["tick_count"], b["close"]) for b in out] == [(60, 60.0), (30, 90.0)]


def messy(symbol, n, seed):
    rng = random.Random(seed)
    t, p, times, prices = 0, 100.0, [], []
    for _ in range(n):
        t += rng.choice([1, 2, 5, 40]) if rng.random() > 0.02 else 400
        p *= 1 + rng.uniform(-0.0003, 0.0003)
        times.append(t - (rng.choice([3, 30]) if rng.random() < 0.1 else 0))
        prices.append(round(p * (1.01 if rng.random() < 0.1 else 1), 6))
    return ticks_of(symbol, times, prices)


@pytest.mark.parametrize("parts", [1, 4])
def test_stateful_cleaning_equals_batch(spark, tmp_path, parts):
    rows = sorted(messy("EURUSD", 300, 1) + messy("USDJPY", 200, 2), key=lambda r: r[2])
    stream = X.clean_bars(feed(spark, tmp_path / "in", rows, parts))
    out = sinks.drain(stream, str(tmp_path / "run")).cache()
    ticks = spark.createDataFrame(rows, S.ARRIVED_TICK)
    flagged = C.flag_spikes(ticks)
    kept = flagged.filter("NOT is_spike").drop("is_spike")
    batch = B.completed_bars(B.tick_bars(C.accepted_ticks(kept), 60), 60)

    def plain(df, *names):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).orderBy(*names[:3]).collect()]

    names = ("symbol", "time", "open", "high", "low", "close", "volume", "tick_count")
    assert plain(X.only_bars(out), *names) == plain(batch, *names)
    gaps = C.tick_gaps(kept).withColumnRenamed("last_tick_time", "last_ts")
    assert plain(X.only_gaps(out), "symbol", "ts", "gap_seconds") == plain(gaps, "symbol", "ts", "gap_seconds")
    late = C.rejected_ticks(kept)
    assert plain(X.late_rows(out), "symbol", "ts", "seq") == plain(late, "symbol", "ts", "seq")
    assert out.filter("kind = 'spike'").count() == flagged.filter("is_spike").count() > 0


def test_reset_row_forgets_the_state(spark, tmp_path):
    rows = [(*r, None) for r in ticks_of("EURUSD", [0, 30, 90], [1.0, 1.0, 1.0])]
    rows.insert(2, ("EURUSD", START, 2, None, None, None, "reset"))
    rows[3] = (*rows[3][:2], 3, *rows[3][3:])
    names = "symbol string, ts timestamp, seq long, bid double, ask double, volume double, control string"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(names).parquet(path)
    out = sinks.drain(X.clean_bars(stream), str(tmp_path / "run"))
    assert out.count() == 0  # no bar closes and no gap is seen over the reset


def test_restart_delivers_each_tick_once(spark, tmp_path):
    rows = ticks_of("EURUSD", range(20), [1.0] * 20)
    place = tmp_path / "in"
    stream = feed(spark, place, rows[:10], 2)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    sinks.write_bars(stream, out, mark).awaitTermination()
    stream = feed(spark, place, rows[10:], 2)
    sinks.write_bars(stream, out, mark).awaitTermination()
    seen = [r["seq"] for r in spark.read.parquet(out).orderBy("seq").collect()]
    assert seen == list(range(20))


def test_listeners(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", ticks_of("EURUSD", range(10), [1.0] * 10), 2)
    seen, failed = [], []
    sinks.notify(stream, str(tmp_path / "a"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 10

    def broken(df, i):
        raise RuntimeError("no")

    query = sinks.notify(stream, str(tmp_path / "b"), broken, lambda e, i: failed.append(str(e)))
    with pytest.raises(Exception):
        query.awaitTermination()
    assert failed == ["no"]


def test_backpressure_reports_levels():
    seen = []
    listener = sinks.Backpressure(lambda name, load: seen.append(load))

    class Progress:
        id, inputRowsPerSecond, processedRowsPerSecond = "q", 95.0, 100.0

    listener.onQueryProgress(type("E", (), {"progress": Progress})())
    assert seen == [0.95]


def test_sliding_rates(spark, tmp_path):
    rows = ticks_of("EURUSD", range(40), [1.0] * 40)
    out = sinks.drain(W.sliding_rates(feed(spark, tmp_path / "in", rows, 2), delay="0 seconds"), str(tmp_path / "run"))
    full = out.filter((F.col("window_start") >= START) & (F.col("ticks") == 10))
    assert full.count() >= 20 and out.agg(F.max("ticks")).first()[0] == 10


def test_two_readers_restart_and_get_each_tick_once(spark, tmp_path):
    rows = sorted(messy("EURUSD", 90, 1) + messy("X/Y Z", 60, 2), key=lambda r: r[2])
    ticks = spark.createDataFrame(rows, S.ARRIVED_TICK)
    path, half = str(tmp_path / "feed"), [r for r in rows if r[2] < 50]
    feeds.append(ticks.filter("seq < 50"), path)
    runs = {}
    for name, limit in (("slow", 20), ("fast", 45)):
        place = str(tmp_path / name)
        out = sinks.deliver(feeds.read_feed(spark, path, S.ARRIVED_TICK, f"{place}/reader", limit), place)
        runs[name] = out
        sizes = [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]
        assert sizes == [limit] * (len(half) // limit) + ([len(half) % limit] if len(half) % limit else [])
    feeds.append(ticks.filter("seq >= 50"), path)
    for name, limit in (("slow", 20), ("fast", 45)):  # both go on from their own checkpoints
        place = str(tmp_path / name)
        out = sinks.deliver(feeds.read_feed(spark, path, S.ARRIVED_TICK, f"{place}/reader", limit), place)
        got = [(r.symbol, r.seq) for r in out.select("symbol", "seq").collect()]
        assert sorted(got) == sorted((r[0], r[2]) for r in rows)
        order = out.groupBy("batch").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("batch").collect()
        assert all(a.hi <= b.lo for a, b in zip(order, order[1:], strict=False))
    plain = sinks.deliver(feeds.read_feed(spark, path, S.ARRIVED_TICK), str(tmp_path / "plain"))
    assert plain.count() == len(rows) and plain.exceptAll(ticks.withColumn("batch", F.lit(0).cast("long"))).isEmpty()


def test_admission_follows_the_load(spark, tmp_path):
    control = sinks.AdmissionControl(spark, str(tmp_path), 1000, least=10)
    assert [control.after(1000, x) for x in (0.1, 0.8, 0.9, 1.0, 7.0)] == [1000, 750, 500, 250, 250]
    assert control.after(100, 0.2) == 125 and control.after(12, 2.0) == 10
    rows = ticks_of("EURUSD", range(100), [1.0] * 100)
    feeds.append(spark.createDataFrame(rows, S.ARRIVED_TICK), str(tmp_path / "feed"))
    control = sinks.AdmissionControl(spark, str(tmp_path / "run/reader"), 40, seconds=1e-6)  # always overloaded
    control.note(-1, 0, 1.0)
    stream = feeds.read_feed(spark, str(tmp_path / "feed"), S.ARRIVED_TICK, str(tmp_path / "run/reader"), 40)
    out = sinks.deliver(stream, str(tmp_path / "run"))
    sizes = [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]
    assert sum(sizes) == 100 and set(sizes[:-1]) == {10}
    assert control.metrics().first()["limit"] == 10


def test_a_limit_needs_a_place(spark, tmp_path):
    with pytest.raises(ValueError):
        feeds.FeedReader(S.ARRIVED_TICK, {"path": str(tmp_path), "limit": "5"})


def test_a_quiet_symbols_bar_closes_by_its_timer(spark, tmp_path):
    """B has one tick and is quiet from then on; A moves the watermark over several batches."""
    rows = ticks_of("A", range(0, 600, 10), [1.0] * 60) + ticks_of("B", [5], [2.0], first=1)
    rows = sorted(rows, key=lambda r: r[1])
    rows = [(s, t, i, *rest) for i, (s, t, _, *rest) in enumerate(rows)]
    place, path = str(tmp_path / "run"), str(tmp_path / "feed")
    feeds.append(spark.createDataFrame(rows, S.ARRIVED_TICK), path)
    stream = feeds.read_feed(spark, path, S.ARRIVED_TICK, f"{place}/reader", 13)
    plain = X.CleanSettings(spike_threshold_percent=None)
    out = X.only_bars(sinks.drain(X.clean_bars(stream, plain, close_after="0 seconds"), place)).collect()
    assert [(r.open, r.tick_count) for r in out if r.symbol == "B"] == [(2.0, 1)]
    assert sorted(r.tick_count for r in out if r.symbol == "A") == [6] * 9
    again = feeds.read_feed(spark, path, S.ARRIVED_TICK, f"{place}/other", 13)
    exact = X.only_bars(sinks.drain(X.clean_bars(again, plain), f"{place}/exact")).collect()
    assert [r.symbol for r in exact if r.symbol == "B"] == []  # without the option it waits for B's next tick


def test_recent_ticks_in_state_over_a_restart(spark, tmp_path):
    rows = sorted(messy("EURUSD", 90, 1) + messy("USDJPY", 8, 2), key=lambda r: r[2])
    place, path = str(tmp_path / "run"), str(tmp_path / "feed")
    ticks = spark.createDataFrame(rows, S.ARRIVED_TICK)
    for some in (ticks.filter("seq < 50"), ticks.filter("seq >= 50")):
        feeds.append(some, path)
        stream = feeds.read_feed(spark, path, S.ARRIVED_TICK, f"{place}/reader", 20)
        held = sinks.drain_updates(X.keep_recent(stream, 25), place, ["symbol"])
    assert {r.symbol: r.held for r in held.collect()} == {"EURUSD": 25, "USDJPY": 8}
    from tickloom.sources.ticks import recent_ticks

    want = recent_ticks(ticks, 25).select("symbol", "seq", "ts", "bid").collect()
    got = X.recent_of(spark, f"{place}/checkpoint").select("symbol", "seq", "ts", "bid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_several_admissions_in_a_micro_batch(spark, tmp_path):
    rows = sorted(messy("EURUSD", 90, 1) + messy("USDJPY", 60, 2) + messy("A", 7, 3), key=lambda r: (r[2], r[0]))
    path, place = str(tmp_path / "feed"), str(tmp_path / "run")
    ticks = spark.createDataFrame(rows, S.ARRIVED_TICK)
    for some in (ticks.filter("seq < 50"), ticks.filter("seq >= 50")):  # the second run goes on from the cursor
        feeds.append(some, path)
        out = sinks.deliver(feeds.read_feed(spark, path, S.ARRIVED_TICK, f"{place}/reader", 11, 4), place)
    half = sum(r[2] < 50 for r in rows)
    cuts = [*range(11, half, 11), half, *range(half + 11, len(rows), 11), len(rows)]
    want = {(r[0], r[2], sum(i >= c for c in cuts)) for i, r in enumerate(rows)}
    got = [(r.symbol, r.seq, r.batch) for r in out.collect()]
    assert len(got) == len(rows) and set(got) == want
    import glob

    assert len(glob.glob(f"{place}/out/micro_batch=*")) == -(-half // 44) + -(-(len(rows) - half) // 44)


def test_row_groups_of_a_feed_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "GROUP_ROWS", 100)
    path = str(tmp_path / "feed")
    feeds.append(spark.createDataFrame(ticks_of("EURUSD", range(950), [1.0] * 950), S.ARRIVED_TICK), path)
    reader = feeds.FeedReader(S.ARRIVED_TICK, {"path": path, "limit": "60", "reader": f"{tmp_path}/reader"})
    assert reader.latestOffset() == {"EURUSD": 59} and len(reader.numbers) < len(reader._groups()["EURUSD"])
    assert reader.latestOffset() == {"EURUSD": 119}


def test_a_micro_batch_does_not_grow_with_the_table():
    from tickloom.plans.stream_queries import TOGETHER, batch_rows

    assert batch_rows(0) == 1 and batch_rows(101) == 21 and batch_rows(36_000_000) == TOGETHER


def test_recent_ticks_sort_a_micro_batch_once(monkeypatch):
    """Arrow hands over small frames; each used to be ranked, turned to rows and sorted with what was held."""
    import pandas as pd

    calls, plain = [], pd.DataFrame.nlargest
    monkeypatch.setattr(pd.DataFrame, "nlargest", lambda *a, **k: calls.append(1) or plain(*a, **k))
    kept = X.RecentTicks(3, S.T.StructType([S.T.StructField("seq", S.T.LongType())]))

    class Ring:
        rows = [(7,)]
        exists = lambda self: True
        get = lambda self: iter(self.rows)

        def put(self, rows):
            self.rows = rows

    kept.ring = Ring()
    frames = [pd.DataFrame({"seq": [i, 40 - i]}) for i in range(10)]
    list(kept.handleInputRows(("A",), iter(frames), None))
    assert kept.ring.rows == [(38,), (39,), (40,)] and len(calls) == 1


def test_many_resets_give_few_frames():
    import pandas as pd

    class Held:
        exists = lambda self: False
        update = lambda self, row: None
        clear = lambda self: None

    cleaner = X.CleanBars(X.CleanSettings(spike_threshold_percent=None))
    cleaner.held = Held()
    frame = pd.DataFrame({"ts": pd.to_datetime([60 * i for i in range(40)], unit="s"), "seq": range(40), "bid": 1.0, "ask": 2.0, "volume": 1.0})
    frame["control"] = ["reset" if i % 4 == 3 else None for i in range(40)]
    out = list(cleaner.handleInputRows(("A",), iter([frame]), None))
    assert len([f for f in out if (f["kind"] == "bar").any()]) == 1 and sum((f["kind"] == "bar").sum() for f in out) == 20
