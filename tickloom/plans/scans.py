"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.bars import ohlc_records, tick_bars
from tickloom.plans.registry import EV, HOURLY, TICKS, USER_TICKS, query, r, rx
from tickloom.session import written
from tickloom.sources import export, fx_views as V, history, ticks as X
from tickloom.sources.store import KeyedStore
from tickloom.streaming.sinks import stream_folder


def hourly(spark, folder):
    return tick_bars(V.ticks(spark, folder), "H1")


@query(
    "s1_tick_range_scan",
    f"WITH {TICKS} SELECT symbol, ts, seq, {r('bid', 'ask', 'volume')} FROM ticks "
    "WHERE symbol = 'X_CLICK' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
def tick_range(spark, folder):
    return X.fetch_tick_data(V.ticks(spark, folder), "x_click", "2024-01-05", "2024-01-20")


@query(
    "s2_ohlc_range_scan",
    f"WITH {HOURLY} SELECT symbol, 'H1' AS timeframe, time AS timestamp, {r('open', 'high', 'low', 'close', 'volume')} "
    "FROM hourly WHERE symbol = 'X_VIEW' AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
def ohlc_range(spark, folder):
    bars = ohlc_records(hourly(spark, folder), "H1")
    found, _ = history.fetch_ohlc_data(bars, "X_VIEW", "H1", "2024-01-05", "2024-01-20", detect_gaps=False)
    return found


@query("s3_list_symbols", f"WITH {USER_TICKS} SELECT DISTINCT symbol FROM ticks")
def symbols(spark, folder):
    return X.list_symbols(V.ticks_by_user(spark, folder))


@query(
    "s4_raw_rates_to_ohlc",
    f"WITH {HOURLY} SELECT symbol, time AS timestamp, "
    + ", ".join(rx(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)", c) for c in ("open", "high", "low", "close"))
    + ", "
    + rx("CAST(CAST(tick_count AS FLOAT) AS DOUBLE)", "volume")
    + ", tick_count % 7 AS spread FROM hourly",
)
def raw_rates(spark, folder):
    raw = hourly(spark, folder).select(
        "symbol",
        F.unix_seconds("time").alias("time"),
        "open",
        "high",
        "low",
        "close",
        F.col("tick_count").alias("tick_volume"),
        (F.col("tick_count") % 7).cast("int").alias("spread"),
        F.lit(0).cast("long").alias("real_volume"),
    )
    return history.raw_to_ohlc(raw, keep=["symbol"])


@query(
    "s5_raw_ticks",
    f"WITH {EV} SELECT 'X_' || upper(event_type) AS symbol, ts AS timestamp, "
    + rx("CAST(CAST(value AS FLOAT) AS DOUBLE)", "bid")
    + ", "
    + rx("CAST(CAST(value + 1 AS FLOAT) AS DOUBLE)", "ask")
    + ", CASE WHEN k % 10 = 0 THEN 0.0::DOUBLE ELSE CAST(k AS DOUBLE) END AS volume FROM ev",
)
def raw_ticks(spark, folder):
    k = V.property_k()
    raw = V.read_table(spark, folder, "events").select(
        (F.unix_micros("ts") / 1_000_000).alias("time"),
        F.col("value").alias("bid"),
        (F.col("value") + 1).alias("ask"),
        F.when(k % 10 != 0, k).cast("long").alias("volume"),
        V.by_type().alias("name"),
    )
    return X.raw_to_ticks(raw, F.col("name"))


@query(
    "s6_merge_extracts",
    f"WITH {HOURLY} SELECT symbol, 'H1' AS timeframe, time AS timestamp, {r('open', 'high', 'low', 'close')}, "
    + rx("CASE WHEN time <= TIMESTAMP '2024-01-16' THEN volume ELSE volume + 1 END", "volume")
    + " FROM hourly",
)
def merged(spark, folder):
    bars = ohlc_records(hourly(spark, folder), "H1")
    first = bars.filter(F.col("timestamp") <= "2024-01-16")
    second = bars.filter(F.col("timestamp") >= "2024-01-12").withColumn("volume", F.col("volume") + 1)
    return history.merge_extracts([first, second, second])


@query(
    "s7_typed_empty_range",
    f"WITH {HOURLY} SELECT symbol, 'H1' AS timeframe, time AS timestamp, open, high, low, close, volume "
    "FROM hourly WHERE time < TIMESTAMP '1999-01-02'",
)
def empty_range(spark, folder):
    bars = ohlc_records(hourly(spark, folder), "H1")
    return history.fetch_ohlc_data(bars, "X_VIEW", "H1", "1999-01-01", "1999-01-02", detect_gaps=False)[0]


def _store(spark, folder):
    store = KeyedStore(spark, stream_folder(spark, "store"))
    store.save_partitioned(V.ticks(spark, folder), "tick")
    return store


@query(
    "s8_keyed_save",
    f"WITH {TICKS} SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, count(*) AS ticks, {rx('sum(bid)', 'bids')} "
    "FROM ticks GROUP BY 1, 2",
)
def keyed_save(spark, folder):
    table = _store(spark, folder).table("tick")
    return table.groupBy("symbol", F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("bid").alias("bids")
    )


@query(
    "s9_keyed_load",
    f"WITH {TICKS} SELECT symbol, '2024-01-05' AS date, seq, ts, {r('bid', 'ask', 'volume')} FROM ticks "
    "WHERE symbol = 'X_VIEW' AND CAST(ts AS DATE) = DATE '2024-01-05'",
)
def keyed_load(spark, folder):
    return _store(spark, folder).load_data("tick/X_VIEW/2024-01-05", "tick")


@query(
    "s8_save_with_metadata",
    f"WITH {TICKS}, t AS (SELECT *, CAST(ts AS DATE) = DATE '2024-01-05' AS again FROM ticks) "
    f"SELECT symbol, count(*) FILTER (NOT again OR seq % 2 = 0) AS ticks, {rx('sum(bid) FILTER (NOT again OR seq % 2 = 0)', 'bids')}, "
    "'even' AS kept, 'tick' AS data_type FROM t GROUP BY 1",
)
def save_with_metadata(spark, folder):
    # one day of each symbol is saved again, with half of its rows; rows and metadata change together
    store, day = _store(spark, folder), "2024-01-05"
    even = V.ticks(spark, folder).filter((F.col("ts").cast("date") == day) & (F.col("seq") % 2 == 0))
    for (symbol,) in X.list_symbols(V.ticks(spark, folder)).collect():
        store.save_data(even.filter(F.col("symbol") == symbol), f"tick/{symbol}/{day}", {"kept": "even"})
    totals = store.table("tick").groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.sum("bid").alias("bids"))
    kept = store.manifest("tick").filter(F.col("date") == day).select("symbol", F.col("metadata")["kept"].alias("kept"), "data_type")
    return totals.join(kept, "symbol")


@query(
    "s10_keyed_delete",
    f"WITH {TICKS} SELECT symbol, count(*) AS ticks FROM ticks "
    "WHERE NOT (symbol = 'X_VIEW' AND CAST(ts AS DATE) = DATE '2024-01-05') GROUP BY 1",
)
def keyed_delete(spark, folder):
    store = _store(spark, folder)
    store.delete_data("tick/X_VIEW/2024-01-05")
    return store.table("tick").groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"))


@query(
    "s11_query_storage",
    f"WITH {TICKS} SELECT symbol, count(*) AS ticks, {rx('max(bid)', 'top')} FROM ticks "
    "WHERE volume >= 50 GROUP BY 1",
)
def stored_query(spark, folder):
    return _store(spark, folder).query_data(
        "SELECT symbol, count(*) AS ticks, max(bid) AS top FROM tick WHERE volume >= :least GROUP BY symbol",
        {"least": 50.0},
    )


@query(
    "s12_list_keys",
    f"WITH {TICKS} SELECT DISTINCT 'tick/' || symbol || '/' || strftime(ts, '%Y-%m-%d') AS key FROM ticks "
    "WHERE symbol = 'X_VIEW'",
)
def stored_keys(spark, folder):
    return _store(spark, folder).list_keys("tick/X_VIEW/*")


@query(
    "s14_new_ticks",
    f"WITH {TICKS}, cursor AS (SELECT symbol, max(seq) AS last_seq FROM ticks WHERE ts < TIMESTAMP '2024-01-16' "
    f"GROUP BY 1) SELECT symbol, ts, seq, {r('bid', 'ask', 'volume')} FROM ticks LEFT JOIN cursor USING (symbol) "
    "WHERE seq > coalesce(last_seq, -1)",
)
def unread(spark, folder):
    ticks = V.ticks(spark, folder)
    cursor = written(X.advance_cursor(ticks.filter(F.col("ts") < "2024-01-16")), "cursor")
    return X.new_ticks(ticks, cursor)


@query(
    "s15_recent_ticks",
    f"WITH {TICKS} SELECT symbol, ts, seq, {r('bid', 'ask', 'volume')} FROM ticks "
    "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 1000",
)
def recent(spark, folder):
    return X.recent_ticks(V.ticks(spark, folder), 1000)


@query(
    "s18_float32_json_record",
    f"WITH {EV} SELECT event_id AS prediction_id, k % 5 <> 0 AS has_upper, k % 3 <> 0 AS has_lower, "
    "TRUE AS has_version, CASE WHEN k % 2 = 0 THEN repeat('v', k) END AS model_version, "
    + rx("CAST(CAST(value AS FLOAT) AS DOUBLE)", "predicted_value")
    + ", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS predicted_at FROM ev",
)
def json_records(spark, folder):
    text = export.to_json_record(V.predictions(spark, folder))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return text.select(
        field("prediction_id").cast("long").alias("prediction_id"),
        F.col("record").contains('"confidence_upper"').alias("has_upper"),
        F.col("record").contains('"confidence_lower"').alias("has_lower"),
        F.col("record").contains('"model_version"').alias("has_version"),
        field("model_version").alias("model_version"),
        field("predicted_value").cast("double").alias("predicted_value"),
        F.substring(field("predicted_at"), 1, 19).alias("predicted_at"),
    )


@query(
    "s19_iso_timestamps",
    f"WITH {TICKS} SELECT seq, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS text FROM ticks",
)
def iso(spark, folder):
    return V.ticks(spark, folder).select("seq", export.iso_timestamp(F.col("ts")).alias("text"))


@query(
    "s20_arrival_batches",
    f"WITH {TICKS}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1) // 100 AS batch "
    "FROM ticks), batches AS (SELECT symbol, batch, count(*) AS ticks, min(ts) AS first_ts, max(ts) AS last_ts, "
    "min(bid) AS min_bid, max(bid) AS max_bid FROM numbered GROUP BY 1, 2) "
    f"SELECT symbol, batch, ticks, first_ts, last_ts, {r('min_bid', 'max_bid')}, "
    + rx("min(min_bid) OVER w", "running_min")
    + ", "
    + rx("max(max_bid) OVER w", "running_max")
    + " FROM batches WINDOW w AS (PARTITION BY symbol ORDER BY batch)",
)
def batches_of_100(spark, folder):
    return X.arrival_batches(V.ticks(spark, folder))
