"""Streaming queries run over everything there is now in several micro-batches, through real checkpoints and sinks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.plans.registry import HOUR, SHUFFLED, TICKS, bars_sql, query, r, rx, seconds
from tickloom.plans.tick_queries import spikes_sql
from tickloom.session import configure
from tickloom.sources import fx_views as V
from tickloom.streaming import bars as S
from tickloom.streaming import feed, sinks, stateful

_BAR = f"{r('open', 'high', 'low', 'close', 'volume')}, tick_count, {r('avg_spread')}"


BATCHES = 5
# Ticks of a micro-batch at most, so that what a task holds of a symbol does not grow with the table.
TOGETHER = 1 << 20


def batch_rows(rows):
    return max(1, min(-(-rows // BATCHES), TOGETHER))


def tick_stream(spark, folder, ticks=None):
    """The event table, or other ticks, as a feed that a reader gets in ``BATCHES`` micro-batches of arrival order, or more of ``TOGETHER`` ticks."""
    configure(spark)
    ticks = V.ticks(spark, folder) if ticks is None else ticks
    place = sinks.stream_folder(spark, "feed")
    feed.append(ticks, f"{place}/feed")
    limit = batch_rows(ticks.count())
    return feed.read_feed(spark, f"{place}/feed", ticks.schema, f"{place}/reader", limit)


@contextmanager
def rocksdb(spark):
    """The state store that keyed state needs, for the queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@query(
    "s13_live_tick_source",
    f"WITH {TICKS} SELECT symbol, count(*) AS ticks, {rx('sum(bid)', 'bids')} FROM ticks GROUP BY 1",
)
def live(spark, folder):
    out = sinks.drain(tick_stream(spark, folder), sinks.stream_folder(spark, "ticks"))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.sum("bid").alias("bids"))


@query(
    "s16_event_listeners",
    f"WITH {TICKS} SELECT symbol, count(*) AS ticks, {rx('min(bid)', 'low')}, {rx('max(bid)', 'high')} FROM ticks GROUP BY 1",
)
def listeners(spark, folder):
    place = sinks.stream_folder(spark, "listener")

    def on_ticks(batch, number):
        batch.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("ticks"), F.min("bid").alias("low"), F.max("bid").alias("high")
        ).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = sinks.notify(tick_stream(spark, folder), f"{place}/checkpoint", on_ticks, trigger={"processingTime": "0 seconds"})
    sinks.until_idle(query)
    return (
        spark.read.parquet(f"{place}/out")
        .groupBy("symbol")
        .agg(F.sum("ticks").alias("ticks"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


@query(
    "s17_st1_completed_bars",
    f"WITH {TICKS}, {bars_sql('b', HOUR)} SELECT symbol, time, time + INTERVAL '1 hour' - INTERVAL '1 microsecond' AS end_time, {_BAR} "
    "FROM b WHERE time + INTERVAL '1 hour' <= (SELECT max(ts) FROM ticks)",
)
def completed(spark, folder):
    return sinks.drain(S.windowed_bars(tick_stream(spark, folder), 3600, delay="0 seconds"), sinks.stream_folder(spark, "bars"))


@query(
    "st2_current_bars",
    f"WITH {TICKS}, {bars_sql('b', HOUR)} SELECT symbol, time, {_BAR} FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1",
)
def current(spark, folder):
    from tickloom.operators.bars import current_bars

    bars = S.windowed_bars(tick_stream(spark, folder), 3600, delay="0 seconds")
    newest = sinks.drain_updates(bars, sinks.stream_folder(spark, "current"), ["symbol", "time"])
    return current_bars(newest).drop("is_complete", "end_time")


SETTINGS = stateful.CleanSettings(
    bar_seconds=3600, gap_threshold=3600.0, spike_threshold_percent=50.0, market_gap=3600.0
)


def cleaned(spark, folder):
    stream = tick_stream(spark, folder).filter(F.col("bid") > 0)
    with rocksdb(spark):
        return sinks.drain(stateful.clean_bars(stream, SETTINGS), sinks.stream_folder(spark, "clean"))


_CLEAN = spikes_sql(TICKS, 50.0, 3_600_000_000) + (
    ", clean AS (SELECT n.symbol, n.ts, n.seq, n.bid, n.ask, n.volume FROM w JOIN n USING (symbol, rn) WHERE NOT is_spike)"
)


@query(
    "st3_stateful_clean_bars",
    _CLEAN
    + f", {bars_sql('b', HOUR, 'clean')} SELECT symbol, time, time + INTERVAL '1 hour' - INTERVAL '1 microsecond' AS end_time, {_BAR} FROM b "
    "QUALIFY lead(time) OVER (PARTITION BY symbol ORDER BY time) IS NOT NULL",
)
def clean_bars(spark, folder):
    return stateful.only_bars(cleaned(spark, folder))


@query(
    "st3_bars_closed_by_timers",
    _CLEAN
    + f", {bars_sql('b', HOUR, 'clean')} SELECT symbol, time, time + INTERVAL '1 hour' - INTERVAL '1 microsecond' AS end_time, {_BAR} FROM b "
    "WHERE time + INTERVAL '1 hour' <= (SELECT max(ts) FROM ticks WHERE bid > 0)",
)
def timed_bars(spark, folder):
    # a quiet symbol's bar closes when the watermark passes its end, without the symbol's next tick
    stream = tick_stream(spark, folder).filter(F.col("bid") > 0)
    with rocksdb(spark):
        out = sinks.drain(stateful.clean_bars(stream, SETTINGS, close_after="0 seconds"), sinks.stream_folder(spark, "timed"))
    return stateful.only_bars(out)


@query(
    "s15_recent_ticks_of_a_stream",
    f"WITH {TICKS} SELECT symbol, ts, seq, {r('bid', 'ask', 'volume')} FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 700",
)
def recent_of_stream(spark, folder):
    place = sinks.stream_folder(spark, "recent")
    with rocksdb(spark):
        sinks.drain_updates(stateful.keep_recent(tick_stream(spark, folder), 700), place, ["symbol"])
        return stateful.recent_of(spark, f"{place}/checkpoint")


@query(
    "st3_stateful_gaps",
    _CLEAN
    + f", g AS (SELECT symbol, lag(ts) OVER w2 AS last_ts, ts, {seconds('lag(ts) OVER w2', 'ts')} AS gap_seconds FROM clean "
    f"WINDOW w2 AS (PARTITION BY symbol ORDER BY seq)) SELECT symbol, last_ts, ts, {r('gap_seconds')} FROM g WHERE gap_seconds > 3600",
)
def clean_gaps(spark, folder):
    return stateful.only_gaps(cleaned(spark, folder))


@query(
    "st4_late_ticks",
    f"WITH {SHUFFLED}"
    " SELECT symbol, ts, last_ts, seq, 'timestamp_reversal' AS reason FROM timed WHERE ts < last_ts",
)
def late(spark, folder):
    disturbed = (F.col("seq") + (F.col("seq") * 7919) % 13) * F.lit(64) + F.col("seq") % 64
    stream = tick_stream(spark, folder, V.ticks(spark, folder).withColumn("seq", disturbed))
    plain = stateful.CleanSettings(bar_seconds=3600, gap_threshold=3600.0, spike_threshold_percent=None)
    with rocksdb(spark):
        return stateful.late_rows(sinks.drain(stateful.clean_bars(stream, plain), sinks.stream_folder(spark, "late")))


@query(
    "st5_sliding_rates",
    f"WITH {TICKS}, s AS (SELECT symbol, unnest([time_bucket(INTERVAL '1 hour', ts) - i * INTERVAL '1 hour' FOR i IN [0, 1, 2]]) AS window_start FROM ticks) "
    "SELECT symbol, window_start, window_start + INTERVAL '3 hours' AS window_end, count(*) AS ticks, "
    + rx("count(*) / 10800e0", "ticks_per_second")
    + " FROM s GROUP BY 1, 2 HAVING window_start + INTERVAL '3 hours' <= (SELECT max(ts) FROM ticks)",
)
def sliding(spark, folder):
    rates = S.sliding_rates(tick_stream(spark, folder), 10_800, 3600, delay="0 seconds")
    return sinks.drain(rates, sinks.stream_folder(spark, "rates"))


@query(
    "st6_reset_state",
    f"WITH {TICKS}, n AS (SELECT *, count(*) FILTER (seq % 500 = 0) OVER (PARTITION BY symbol ORDER BY seq) AS run FROM ticks), "
    f"kept AS (SELECT symbol || '|' || run AS symbol, ts, seq, bid, ask, volume FROM n WHERE seq % 500 <> 0), {bars_sql('b', HOUR, 'kept')} "
    f"SELECT split_part(symbol, '|', 1) AS symbol, time, {_BAR} FROM b QUALIFY lead(time) OVER (PARTITION BY symbol ORDER BY time) IS NOT NULL",
)
def reset(spark, folder):
    # Every 500th event stands for a control row: what was held for its symbol is forgotten.
    stream = tick_stream(spark, folder).withColumn("control", F.when(F.col("seq") % 500 == 0, "reset"))
    plain = stateful.CleanSettings(bar_seconds=3600, gap_threshold=3600.0, spike_threshold_percent=None)
    with rocksdb(spark):
        out = sinks.drain(stateful.clean_bars(stream, plain), sinks.stream_folder(spark, "reset"))
    return stateful.only_bars(out).drop("end_time")


@query(
    "st7_admission_control",
    f"WITH {TICKS}, n AS (SELECT count(*) AS rows FROM ticks), "
    "b AS (SELECT unnest(range(CAST(ceil(rows / 1500e0) AS BIGINT))) AS batch, rows FROM n) "
    "SELECT batch, least(1500, rows - batch * 1500)::BIGINT AS admitted, least(rows, (batch + 1) * 1500)::BIGINT AS delivered FROM b",
)
def admission(spark, folder):
    # 1,500 ticks a batch are admitted; the rest waits in the feed, and nothing is lost. A micro-batch takes several of
    # these batches, since their number grows with the table
    ticks, place = V.ticks(spark, folder), sinks.stream_folder(spark, "admission")
    feed.append(ticks, f"{place}/feed")
    admissions = -(-batch_rows(ticks.count()) // 1500)
    stream = feed.read_feed(spark, f"{place}/feed", ticks.schema, f"{place}/reader", 1500, admissions)
    sizes = sinks.deliver(stream, place).groupBy("batch").agg(F.count_distinct("symbol", "seq").alias("admitted"))
    so_far = F.sum("admitted").over(Window.orderBy("batch"))  # one row per batch
    return sizes.select("batch", "admitted", so_far.alias("delivered"))


@query(
    "s14_two_readers",
    f"WITH {TICKS}, r AS (SELECT unnest(['fast', 'slow']) AS reader) "
    f"SELECT reader, symbol, count(*) AS ticks, count(DISTINCT seq) AS different, {rx('sum(bid)', 'bids')} FROM ticks, r GROUP BY 1, 2",
)
def two_readers(spark, folder):
    # the feed grows between two runs of each reader; each goes on from its own cursor
    ticks, place = V.ticks(spark, folder), sinks.stream_folder(spark, "readers")
    middle, rows = ticks.agg(F.percentile_approx("seq", 0.5), F.count("*")).first()
    for some in (ticks.filter(F.col("seq") <= middle), ticks.filter(F.col("seq") > middle)):
        feed.append(some, f"{place}/feed")
        got = {}
        for reader, limit in (("fast", 4000), ("slow", 1300)):
            own = f"{place}/{reader}"
            stream = feed.read_feed(spark, f"{place}/feed", ticks.schema, f"{own}/reader", limit, -(-batch_rows(rows) // (2 * limit)))
            got[reader] = sinks.deliver(stream, own).withColumn("reader", F.lit(reader))
    both = got["fast"].unionByName(got["slow"])
    return both.groupBy("reader", "symbol").agg(
        F.count(F.lit(1)).alias("ticks"), F.count_distinct("seq").alias("different"), F.sum("bid").alias("bids")
    )
