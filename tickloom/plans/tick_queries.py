"""Stateful tick operators in arrival order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import clean as C
from tickloom.operators.bars import tick_bars
from tickloom.operators.ordered import by_seq, equal_depth
from tickloom.plans.registry import HOURLY, MINUTE, SHUFFLED, TICKS, USER_TICKS, bars_sql, query, r, rx, seconds
from tickloom.sources import fx_views as V

# The disturbed arrival numbers are 64 times as sparse as the rows.
WIDE = by_seq(1 << 26)

_COLUMNS = f"symbol, ts, seq, {r('bid', 'ask', 'volume')}"


@query("t1_accepted_ticks", f"WITH {SHUFFLED} SELECT {_COLUMNS} FROM timed WHERE last_ts IS NULL OR ts >= last_ts")
def accepted(spark, folder):
    return C.accepted_ticks(V.shuffled_ticks(spark, folder), WIDE)


@query(
    "t1_rejected_ticks",
    f"WITH {SHUFFLED} SELECT {_COLUMNS}, last_ts AS last_tick_time, 'timestamp_reversal' AS reason FROM timed WHERE ts < last_ts",
)
def rejected(spark, folder):
    return C.rejected_ticks(V.shuffled_ticks(spark, folder), WIDE)


GAPS = (
    f"{SHUFFLED}, gaps AS (SELECT symbol, last_ts AS last_tick_time, ts, {seconds('last_ts', 'ts')} AS gap_seconds FROM timed "
    "WHERE epoch_us(ts) - epoch_us(last_ts) > 3600000000)"
)


def gaps(spark, folder):
    return C.tick_gaps(V.shuffled_ticks(spark, folder), 3600.0, WIDE)


@query("t2_tick_gaps", f"WITH {GAPS} SELECT symbol, last_tick_time, ts, {r('gap_seconds')}, 3600::DOUBLE AS threshold FROM gaps")
def tick_gaps(spark, folder):
    return gaps(spark, folder)


def spikes_sql(source: str, threshold: float, gap_us: int) -> str:
    """One step per arrival: the fold a single reader would do."""
    move = "greatest(abs((n.bid - w.bid) / w.bid) * 100, abs((n.ask - w.ask) / w.ask) * 100)"
    spike = f"(epoch_us(n.ts) - epoch_us(w.last_ts) <= {gap_us} AND {move} > {threshold})"
    return (
        f"WITH RECURSIVE {source}, good AS (SELECT * FROM ticks WHERE bid > 0), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS rn FROM good), "
        "w AS (SELECT symbol, rn, seq, ts AS last_ts, bid, ask, FALSE AS is_spike FROM n WHERE rn = 1 UNION ALL "
        f"SELECT n.symbol, n.rn, n.seq, CASE WHEN {spike} THEN w.last_ts ELSE n.ts END, "
        f"CASE WHEN {spike} THEN w.bid ELSE n.bid END, CASE WHEN {spike} THEN w.ask ELSE n.ask END, {spike} "
        "FROM w JOIN n ON n.symbol = w.symbol AND n.rn = w.rn + 1)"
    )


@query(
    "t3_percent_spike_filter",
    spikes_sql(TICKS, 50.0, 3_600_000_000) + " SELECT symbol, seq, is_spike FROM w",
)
def spikes(spark, folder):
    ticks = V.ticks(spark, folder).filter(F.col("bid") > 0).drop("volume")
    return C.flag_spikes(ticks, 50.0, 3600.0).select("symbol", "seq", "is_spike")


@query(
    "t3_percent_spike_filter_equal_slices",
    spikes_sql(TICKS, 50.0, 3_600_000_000) + " SELECT symbol, seq, is_spike FROM w",
)
def spikes_in_equal_slices(spark, folder):
    ticks = V.ticks(spark, folder).filter(F.col("bid") > 0).drop("volume")
    return C.flag_spikes(ticks, 50.0, 3600.0, slicing=equal_depth(ticks, "seq", 300)).select("symbol", "seq", "is_spike")


@query(
    "t3_percent_spike_filter_many_symbols",
    spikes_sql(USER_TICKS, 80.0, 86_400_000_000) + " SELECT symbol, seq, is_spike FROM w",
)
def spikes_by_user(spark, folder):
    ticks = V.ticks_by_user(spark, folder).filter(F.col("bid") > 0).drop("volume")
    return C.flag_spikes(ticks, 80.0, 86_400.0).select("symbol", "seq", "is_spike")


def _z(c: str) -> str:
    return f"coalesce(CASE WHEN stddev_samp({c}) OVER w > 0 THEN abs(({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w) END, 0)"


@query(
    "t4_zscore_flags",
    f"WITH {TICKS}, z AS (SELECT symbol, seq, {_z('bid')} AS bid_z, {_z('ask')} AS ask_z, count(*) OVER w AS n FROM ticks "
    "WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)) "
    f"SELECT symbol, seq, {r('bid_z', 'ask_z')}, n >= 100 AND (bid_z > 3 OR ask_z > 3) AS is_spike FROM z",
)
def zscore(spark, folder):
    return C.zscore_flags(V.ticks(spark, folder)).select("symbol", "seq", "bid_z", "ask_z", "is_spike")


@query(
    "t5_rolling_mean_std",
    f"WITH {TICKS} SELECT symbol, seq, {rx('avg(bid) OVER w', 'bid_mean')}, {rx('coalesce(stddev_samp(bid) OVER w, 0)', 'bid_std')}, "
    f"{rx('avg(ask) OVER w', 'ask_mean')}, {rx('coalesce(stddev_samp(ask) OVER w, 0)', 'ask_std')} FROM ticks "
    "WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
)
def rolling(spark, folder):
    out = C.rolling_mean_std(V.ticks(spark, folder), 50)
    return out.select("symbol", "seq", "bid_mean", "bid_std", "ask_mean", "ask_std")


@query(
    "t6_tick_summary",
    f"WITH {USER_TICKS} SELECT symbol, {rx('avg(bid)', 'bid_mean')}, {rx('stddev_pop(bid)', 'bid_std')}, {rx('avg(ask)', 'ask_mean')}, "
    f"{rx('stddev_pop(ask)', 'ask_std')}, {rx('avg(volume)', 'volume_mean')}, count(*) AS ticks FROM ticks GROUP BY 1",
)
def summary(spark, folder):
    return C.tick_summary(V.ticks_by_user(spark, folder))


@query(
    "t7_counters",
    spikes_sql(TICKS, 50.0, 3_600_000_000)
    + ", d AS (SELECT w.symbol, is_spike, n.volume < 10 AS dropped FROM w JOIN n USING (symbol, rn)) "
    "SELECT symbol, count(*) AS total_ticks, count(*) FILTER (is_spike) AS spike_count, "
    + rx("count(*) FILTER (is_spike) / count(*)::DOUBLE * 100", "spike_percent")
    + ", count(*) FILTER (dropped) AS dropped_count, "
    + rx("count(*) FILTER (dropped) / count(*)::DOUBLE * 100", "dropped_percent")
    + " FROM d GROUP BY 1",
)
def counters(spark, folder):
    ticks = V.ticks(spark, folder).filter(F.col("bid") > 0)
    flagged = C.flag_spikes(ticks, 50.0, 3600.0).withColumn("dropped", F.col("volume") < 10)
    return C.counters(flagged, dropped="dropped")


@query(
    "t8_latency_summary",
    f"WITH {USER_TICKS}, few AS (SELECT symbol, volume AS x FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 100), "
    "s AS (SELECT symbol, list_sort(list(x)) AS l, avg(x) AS avg, max(x) AS max FROM few GROUP BY 1) "
    "SELECT symbol, round(avg, 2) + 0.0 AS avg, round(l[least(CAST(floor(len(l) * 0.95) AS BIGINT), len(l) - 1) + 1], 2) + 0.0 AS p95, "
    "round(max, 2) + 0.0 AS max FROM s",
)
def latency(spark, folder):
    samples = V.ticks_by_user(spark, folder).withColumnRenamed("volume", "latency_ms")
    return C.latency_summary(samples)


@query(
    "t9_gap_summary",
    f"WITH {GAPS}, span AS (SELECT symbol, {seconds('min(ts)', 'max(ts)')} AS elapsed FROM shuffled GROUP BY 1) "
    "SELECT symbol, count(gap_seconds) AS gap_count, "
    f"{rx('coalesce(max(gap_seconds), 0)', 'max_gap')}, {rx('coalesce(sum(gap_seconds), 0)', 'total_gap')}, "
    f"{rx('coalesce(avg(gap_seconds), 0)', 'avg_gap')}, {rx('coalesce(sum(gap_seconds) * 100 / max(elapsed), 0)', 'gap_percent')} "
    "FROM span LEFT JOIN gaps USING (symbol) GROUP BY 1",
)
def gap_summary(spark, folder):
    return C.gap_summary(gaps(spark, folder), V.shuffled_ticks(spark, folder))


@query(
    "t10_gap_events",
    f"WITH {GAPS} SELECT symbol, last_tick_time AS before, ts AS after, {rx('gap_seconds', 'seconds')}, "
    "CASE WHEN gap_seconds < 5400 THEN 'Low' WHEN gap_seconds < 7200 THEN 'Medium' ELSE 'High' END AS impact FROM gaps",
)
def gap_log(spark, folder):
    return C.gap_events(gaps(spark, folder), 5400.0, 7200.0)


@query(
    "t11_trailing_rates",
    f"WITH {TICKS}, n AS (SELECT symbol, seq, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) "
    "RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS c FROM ticks) SELECT symbol, seq, "
    + rx("c / 36000e0", "tick_rate")
    + " FROM n",
)
def rates(spark, folder):
    out = C.trailing_rate(V.ticks(spark, folder), 36_000, 36_000.0, "tick_rate")
    return out.select("symbol", "seq", "tick_rate")


@query(
    "t11_bar_rate",
    f"WITH {TICKS}, {bars_sql('b', MINUTE)}, n AS (SELECT symbol, time, count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(time) "
    "RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS c FROM b) SELECT symbol, time, "
    + rx("c / 5e0", "bars_per_minute")
    + " FROM n",
)
def bar_rate(spark, folder):
    bars = tick_bars(V.ticks(spark, folder), "M1")
    return C.trailing_rate(bars, 300, 5.0, "bars_per_minute", time="time").select("symbol", "time", "bars_per_minute")


@query(
    "t12_run_rates",
    f"WITH {HOURLY}, t AS (SELECT symbol, count(*) AS ticks, {seconds('min(ts)', 'max(ts)')} AS elapsed FROM ticks GROUP BY 1), "
    "b AS (SELECT symbol, count(*) AS bars FROM hourly GROUP BY 1) SELECT symbol, ticks, bars, "
    f"{rx('ticks / elapsed', 'ticks_per_second')}, {rx('bars / elapsed * 60', 'bars_per_minute')}, {rx('ticks / bars', 'ticks_per_bar')} "
    "FROM t JOIN b USING (symbol)",
)
def run_rates(spark, folder):
    ticks = V.ticks(spark, folder)
    return C.run_rates(ticks, tick_bars(ticks, "H1"))
