"""Ticks to bars, resampling, indicators and bar statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as P
from tickloom.operators import bars as B
from tickloom.operators import clean as C
from tickloom.operators import gaps as G
from tickloom.operators import indicators as I
from tickloom.operators import stats as A
from tickloom.operators.ordered import by_bars
from tickloom.plans.registry import (
    HOUR,
    HOURLY,
    LINES,
    MINUTE,
    SHUFFLED,
    TICKS,
    USER_TICKS,
    bars_sql,
    query,
    r,
    rx,
    seconds,
)
from tickloom.plans.scans import hourly
from tickloom.plans.tick_queries import GAPS, WIDE
from tickloom.sources import fx_views as V

OHLCV = ("open", "high", "low", "close", "volume")
_BAR = f"{r(*OHLCV)}, tick_count, {r('avg_spread')}"


@query(
    "b1_tick_bars",
    f"WITH {SHUFFLED}, kept AS (SELECT * FROM timed WHERE last_ts IS NULL OR ts >= last_ts), {bars_sql('b', HOUR, 'kept')} "
    f"SELECT symbol, time, time + INTERVAL '1 hour' - INTERVAL '1 microsecond' AS end_time, {_BAR} FROM b",
)
def tick_bars(spark, folder):
    return B.tick_bars(C.accepted_ticks(V.shuffled_ticks(spark, folder), WIDE), "H1")


@query(
    "b1_minute_bars",
    f"WITH {TICKS}, {bars_sql('b', MINUTE)} SELECT symbol, time, time + INTERVAL '1 minute' - INTERVAL '1 microsecond' AS end_time, {_BAR} FROM b",
)
def minute_bars(spark, folder):
    return B.tick_bars(V.ticks(spark, folder), "M1")


for _tf, _bucket, _end in (
    ("D1", "time_bucket(INTERVAL '1 day', ts)", "time + INTERVAL '1 day'"),
    ("W1", "date_trunc('week', ts)", "time + INTERVAL '7 days'"),
    ("MN", "date_trunc('month', ts)", "time + INTERVAL '1 month'"),
):

    @query(
        f"b1_lineitem_bars_{_tf.lower()}",
        f"WITH {LINES}, {bars_sql('b', _bucket, 'lines')} SELECT symbol, time, {_end} - INTERVAL '1 microsecond' AS end_time, {_BAR} FROM b",
    )
    def _lineitem(spark, folder, tf=_tf):
        return B.tick_bars(V.lineitem_ticks(spark, folder), tf)


@query(
    "b1_decimal_bars",
    f"WITH {TICKS}, q AS (SELECT symbol, ts, seq, CAST(CAST(bid AS FLOAT) AS DOUBLE) AS bid, CAST(CAST(ask AS FLOAT) AS DOUBLE) AS ask, "
    f"volume FROM ticks), {bars_sql('b', HOUR, 'q')} SELECT symbol, time, {_BAR} FROM b",
)
def decimal_bars(spark, folder):
    return B.tick_bars(V.ticks(spark, folder), "H1", numeric="decimal").drop("end_time")


@query(
    "b2_bar_bounds",
    f"WITH {TICKS} SELECT DISTINCT symbol, time_bucket(INTERVAL '5 minutes', ts) AS time, "
    "time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '299999999 microseconds' AS end_time FROM ticks",
)
def bounds(spark, folder):
    return B.tick_bars(V.ticks(spark, folder), 300).select("symbol", "time", "end_time")


@query(
    "b3_complete_and_current",
    f"WITH {HOURLY} SELECT symbol, time, tick_count, lead(time) OVER (PARTITION BY symbol ORDER BY time) IS NOT NULL AS is_complete FROM hourly",
)
def completeness(spark, folder):
    return B.mark_complete(hourly(spark, folder), "H1").select("symbol", "time", "tick_count", "is_complete")


@query(
    "b4_average_spread",
    f"WITH {USER_TICKS} SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS time, {rx('avg(ask - bid)', 'avg_spread')} FROM ticks GROUP BY 1, 2",
)
def average_spread(spark, folder):
    return B.tick_bars(V.ticks_by_user(spark, folder), "D1").select("symbol", "time", "avg_spread")


@query(
    "b5_bar_retention",
    f"WITH {HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM hourly) "
    f"SELECT symbol, time, {r(*OHLCV)} FROM n WHERE back BETWEEN 2 AND 101",
)
def retention(spark, folder):
    return B.retain_newest(hourly(spark, folder), 100, "H1").select("symbol", "time", *OHLCV)


@query(
    "b6_multi_symbol_summary",
    f"WITH {GAPS}, kept AS (SELECT * FROM timed WHERE last_ts IS NULL OR ts >= last_ts), {bars_sql('b', HOUR, 'kept')}, "
    "s AS (SELECT symbol, CAST(sum(tick_count) AS BIGINT) AS ticks, count(*) AS bars, avg(avg_spread) AS mean_spread FROM b GROUP BY 1), "
    "g AS (SELECT symbol, count(*) AS gaps FROM gaps GROUP BY 1) "
    f"SELECT symbol, ticks, bars, coalesce(gaps, 0) AS gaps, {r('mean_spread')} FROM s LEFT JOIN g USING (symbol)",
)
def multi_symbol(spark, folder):
    ticks = V.shuffled_ticks(spark, folder)
    bars = B.tick_bars(C.accepted_ticks(ticks, WIDE), "H1")
    return B.symbol_summary(bars, C.tick_gaps(ticks, 3600.0, WIDE))


@query(
    "b7_tick_to_ohlc",
    f"WITH {TICKS}, {bars_sql('b', 'time_bucket(INTERVAL 4 hours, ts)')} SELECT symbol, time AS timestamp, 'H4' AS timeframe, {r(*OHLCV)} "
    "FROM b WHERE symbol = 'X_ERROR'",
)
def to_ohlc(spark, folder):
    return B.process_tick_to_ohlc(V.ticks(spark, folder), "H4", symbol="x_error")


@query(
    "b8_mid_price_bars",
    f"WITH {TICKS}, {bars_sql('b', HOUR, price='(bid + ask) / 2')} SELECT symbol, time, {r(*OHLCV)}, tick_count FROM b",
)
def mid_bars(spark, folder):
    return B.tick_bars(V.ticks(spark, folder), "H1", price="mid").drop("end_time", "avg_spread")


@query(
    "b9_broker_bars",
    f"WITH {TICKS}, q AS (SELECT *, {HOUR} AS time, CAST(trunc((ask - bid) * 100000) AS BIGINT) AS points FROM ticks) "
    "SELECT symbol, time, "
    + ", ".join(
        rx(e, n)
        for e, n in (("arg_min(bid, seq)", "open"), ("max(bid)", "high"), ("min(bid)", "low"), ("arg_max(bid, seq)", "close"))
    )
    + ", count(*) AS tick_volume, arg_max(points, seq) AS spread FROM q GROUP BY 1, 2",
)
def broker(spark, folder):
    return B.broker_bars(V.ticks(spark, folder), "H1")


@query(
    "b10_bar_progress",
    f"WITH {HOURLY} SELECT symbol, time, {rx('least(tick_count / 4e0 * 100, 100)', 'progress')}, "
    + rx("greatest(least((epoch_us(TIMESTAMP '2024-01-20 00:20:00') - epoch_us(time)) / 3599999999e0 * 100, 100), 0)", "elapsed")
    + " FROM hourly",
)
def progress(spark, folder):
    bars = B.with_progress(hourly(spark, folder), 4.0)
    now = F.lit("2024-01-20 00:20:00").cast("timestamp")
    return bars.select("symbol", "time", "progress", P.bar_elapsed(F.col("time"), F.col("end_time"), now).alias("elapsed"))


@query(
    "b11_resample_ohlc",
    f"WITH {HOURLY} SELECT symbol, time_bucket(INTERVAL '1 day', h.time) AS time, {rx('arg_min(open, h.time)', 'open')}, {rx('max(high)', 'high')}, "
    f"{rx('min(low)', 'low')}, {rx('arg_max(close, h.time)', 'close')}, {rx('sum(volume)', 'volume')}, count(*) AS source_bars "
    "FROM hourly h GROUP BY 1, 2",
)
def resampled(spark, folder):
    return B.resample_ohlc(hourly(spark, folder), "H1", "D1")


# --- indicators ---------------------------------------------------------------


def _full(n: int, e: str, name: str) -> str:
    frame = f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return rx(f"CASE WHEN count(*) OVER {frame} >= {n} THEN {e} OVER {frame} END", name)


@query("i1_sma", f"WITH {HOURLY} SELECT symbol, time, {r('close')}, {_full(20, 'avg(close)', 'SMA_20')} FROM hourly")
def sma(spark, folder):
    return I.sma(hourly(spark, folder)).select("symbol", "time", "close", "SMA_20")


@query(
    "i2_moving_averages",
    f"WITH {HOURLY} SELECT symbol, time, " + ", ".join(_full(n, "avg(close)", f"MA{n}") for n in (5, 20, 50)) + " FROM hourly",
)
def moving(spark, folder):
    return I.moving_averages(hourly(spark, folder)).select("symbol", "time", "MA5", "MA20", "MA50")


_BB = (
    f"{HOURLY}, m AS (SELECT symbol, time, close, CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END AS bb_middle, "
    "CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(close) OVER w END AS bb_std FROM hourly "
    "WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"
)
_BB_COLUMNS = f"{r('bb_middle', 'bb_std')}, {rx('bb_middle + 2 * bb_std', 'bb_upper')}, {rx('bb_middle - 2 * bb_std', 'bb_lower')}"


@query("i3_bollinger", f"WITH {_BB} SELECT symbol, time, {_BB_COLUMNS} FROM m")
def bollinger(spark, folder):
    return I.bollinger(hourly(spark, folder)).select("symbol", "time", "bb_middle", "bb_std", "bb_upper", "bb_lower")


@query(
    "i4_latest_indicators",
    f"WITH {_BB} SELECT symbol, time, {r('close')}, {_BB_COLUMNS} FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1",
)
def latest(spark, folder):
    out = I.latest(I.bollinger(hourly(spark, folder)))
    return out.select("symbol", "time", "close", "bb_middle", "bb_std", "bb_upper", "bb_lower")


@query(
    "i5_calculate_indicators",
    f"WITH {_BB} SELECT symbol, time, {_full(10, 'avg(close)', 'SMA_10')}, {_BB_COLUMNS} FROM m",
)
def dispatched(spark, folder):
    out = I.calculate_indicators(hourly(spark, folder), ["sma", "bollinger"], SMA={"period": 10})
    return out.select("symbol", "time", "SMA_10", "bb_middle", "bb_std", "bb_upper", "bb_lower")


_N = "n AS (SELECT symbol, time, close, close - lag(close) OVER w AS d, row_number() OVER w AS rn FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY time))"


@query(
    "i6_rsi",
    f"WITH RECURSIVE {HOURLY}, {_N}, seed AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM n WHERE rn BETWEEN 2 AND 15 "
    "GROUP BY 1), f AS (SELECT n.symbol, rn, time, g, l FROM n JOIN seed USING (symbol) WHERE rn = 15 UNION ALL "
    "SELECT n.symbol, n.rn, n.time, (f.g * 13 + greatest(n.d, 0)) / 14, (f.l * 13 + greatest(-n.d, 0)) / 14 FROM f JOIN n "
    "ON n.symbol = f.symbol AND n.rn = f.rn + 1) SELECT n.symbol, n.time, "
    + rx("CASE WHEN n.rn >= 15 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END", "RSI_14")
    + " FROM n LEFT JOIN f ON n.symbol = f.symbol AND n.rn = f.rn",
)
def rsi(spark, folder):
    return I.rsi(hourly(spark, folder)).select("symbol", "time", "RSI_14")


_FILLED = (
    "ends AS (SELECT symbol, min(time) AS a, max(time) AS z FROM hourly GROUP BY 1), grid AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS time FROM ends), "
    "filled AS (SELECT g.symbol, g.time, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.time ROWS UNBOUNDED PRECEDING) AS close "
    "FROM grid g LEFT JOIN hourly h ON g.symbol = h.symbol AND g.time = h.time)"
)


@query(
    "i6_rsi_of_filled_bars",
    f"WITH RECURSIVE {HOURLY}, {_FILLED}, {_N.replace('FROM hourly', 'FROM filled')}, seed AS (SELECT symbol, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM n WHERE rn BETWEEN 2 AND 15 "
    "GROUP BY 1), f AS (SELECT n.symbol, rn, time, g, l FROM n JOIN seed USING (symbol) WHERE rn = 15 UNION ALL "
    "SELECT n.symbol, n.rn, n.time, (f.g * 13 + greatest(n.d, 0)) / 14, (f.l * 13 + greatest(-n.d, 0)) / 14 FROM f JOIN n "
    "ON n.symbol = f.symbol AND n.rn = f.rn + 1) SELECT n.symbol, n.time, "
    + rx("CASE WHEN n.rn >= 15 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END", "RSI_14")
    + " FROM n LEFT JOIN f ON n.symbol = f.symbol AND n.rn = f.rn",
)
def rsi_of_filled(spark, folder):
    filled = G.fill_gaps(hourly(spark, folder), "H1", "forward")
    return I.rsi(filled, block_rows=100).select("symbol", "time", "RSI_14")


def _step(alpha: float, name: str, x: str = "n.close") -> str:
    return f"{alpha!r}::DOUBLE * {x} + {1 - alpha!r}::DOUBLE * e.{name}"


@query(
    "i7_macd",
    f"WITH RECURSIVE {HOURLY}, {_N}, e AS (SELECT symbol, rn, time, close AS fast, close AS slow, 0::DOUBLE AS sig FROM n WHERE rn = 1 UNION ALL "
    "SELECT symbol, rn, time, fast, slow, 2e0 / 10 * (fast - slow) + (1 - 2e0 / 10) * sig FROM (SELECT n.symbol, n.rn, n.time, "
    "2e0 / 13 * n.close + (1 - 2e0 / 13) * e.fast AS fast, 2e0 / 27 * n.close + (1 - 2e0 / 27) * e.slow AS slow, e.sig FROM e JOIN n "
    "ON n.symbol = e.symbol AND n.rn = e.rn + 1)) SELECT symbol, time, "
    f"{rx('fast - slow', 'macd')}, {rx('sig', 'macd_signal')}, {rx('fast - slow - sig', 'macd_hist')} FROM e",
)
def macd(spark, folder):
    return I.macd(hourly(spark, folder)).select("symbol", "time", "macd", "macd_signal", "macd_hist")


@query(
    "i8_ema",
    f"WITH RECURSIVE {HOURLY}, {_N}, e AS (SELECT symbol, rn, time, "
    + ", ".join(f"close AS e{n}" for n in I.EMA_PERIODS)
    + " FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, n.time, "
    + ", ".join(f"2e0 / {n + 1} * n.close + (1 - 2e0 / {n + 1}) * e.e{n}" for n in I.EMA_PERIODS)
    + " FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1) SELECT symbol, time, "
    + ", ".join(rx(f"e{n}", f"EMA_{n}") for n in I.EMA_PERIODS)
    + " FROM e",
)
def ema(spark, folder):
    return I.ema(hourly(spark, folder)).select("symbol", "time", *[f"EMA_{n}" for n in I.EMA_PERIODS])


def _rci(n: int) -> str:
    last = f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    rank = "len([y FOR y IN x IF y < x[i]]) + (len([y FOR y IN x IF y = x[i]]) + 1) / 2e0"
    return (
        f"r{n} AS (SELECT symbol, time, CASE WHEN len(x) = {n} THEN (1 - 6 * list_sum([pow(i - ({rank}), 2) FOR i IN range(1, {n + 1})]) "
        f"/ ({n}e0 * ({n * n} - 1))) * 100 END AS v FROM (SELECT symbol, time, list(close) OVER {last} AS x FROM hourly))"
    )


@query(
    "i9_rci",
    f"WITH {HOURLY}, {_rci(9)}, {_rci(24)} SELECT a.symbol, a.time, {rx('a.v', 'RCI_9')}, {rx('b.v', 'RCI_24')} "
    "FROM r9 a JOIN r24 b ON a.symbol = b.symbol AND a.time = b.time",
)
def rci(spark, folder):
    return I.rci(hourly(spark, folder), [9, 24]).select("symbol", "time", "RCI_9", "RCI_24")


# --- tick statistics ----------------------------------------------------------

_RET = "ret AS (SELECT *, CASE WHEN lag(bid) OVER w <> 0 THEN bid / lag(bid) OVER w - 1 END AS x, row_number() OVER w AS rn FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY seq))"


@query("i10_returns", f"WITH {TICKS}, {_RET} SELECT symbol, seq, {rx('x', 'return')} FROM ret WHERE rn > 1")
def returns(spark, folder):
    return A.returns(V.ticks(spark, folder)).select("symbol", "seq", "return")


@query(
    "i11_rolling_volatility",
    f"WITH {TICKS}, {_RET}, v AS (SELECT symbol, seq, CASE WHEN rn > 10 THEN stddev_samp(x) OVER (PARTITION BY symbol ORDER BY seq "
    "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * sqrt(252) * 100 END AS v FROM ret) SELECT symbol, "
    f"{rx('arg_max(v, seq)', 'current_vol')}, {rx('avg(v)', 'avg_vol')}, {rx('max(v)', 'max_vol')} FROM v WHERE v IS NOT NULL GROUP BY 1",
)
def volatility(spark, folder):
    return A.volatility_summary(A.rolling_volatility(V.ticks(spark, folder)))


@query(
    "i12_normalised_price",
    f"WITH {TICKS} SELECT symbol, seq, {rx('bid / first_value(bid) OVER (PARTITION BY symbol ORDER BY seq) * 100', 'normalised')} FROM ticks",
)
def normalised(spark, folder):
    return A.normalised_price(V.ticks(spark, folder)).select("symbol", "seq", "normalised")


@query(
    "i13_correlation_matrix",
    f"WITH {USER_TICKS}, n AS (SELECT symbol, bid, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS back, "
    "count(*) OVER (PARTITION BY symbol) AS c FROM ticks), q AS (SELECT * FROM n WHERE c > 50), "
    "s AS (SELECT least(min(c), 100) AS m FROM q) SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, "
    f"{rx('corr(a.bid, b.bid)', 'r')} FROM q a JOIN q b ON a.back = b.back AND a.symbol < b.symbol WHERE a.back <= (SELECT m FROM s) GROUP BY 1, 2",
)
def correlation(spark, folder):
    return A.correlation_matrix(V.ticks_by_user(spark, folder))


@query(
    "i13_correlation_by_time",
    f"WITH {HOURLY} SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n, {rx('corr(a.close, b.close)', 'r')} "
    "FROM hourly a JOIN hourly b ON a.time = b.time AND a.symbol < b.symbol GROUP BY 1, 2",
)
def correlation_time(spark, folder):
    return A.correlation_by_time(hourly(spark, folder))


@query(
    "i14_performance",
    f"WITH {TICKS}, {_RET} SELECT symbol, count(*) AS ticks, {rx('arg_min(bid, seq)', 'first_price')}, {rx('arg_max(bid, seq)', 'last_price')}, "
    f"{rx('arg_max(bid, seq) - arg_min(bid, seq)', 'change')}, "
    + rx("(arg_max(bid, seq) - arg_min(bid, seq)) / arg_min(bid, seq) * 100", "change_percent")
    + f", {rx('stddev_samp(x) * 100', 'volatility')}, {rx('avg(ask - bid)', 'avg_spread')}, {rx('max(ask - bid)', 'max_spread')} "
    "FROM ret GROUP BY 1 HAVING count(*) >= 2",
)
def performance(spark, folder):
    return A.performance(V.ticks(spark, folder))


_MOVE = (
    f"{rx('f', 'first_close')}, {rx('l', 'last_close')}, {rx('l - f', 'change')}, "
    + rx("CASE WHEN f = 0 THEN 0 ELSE (l - f) / f * 100 END", "change_percent")
)


@query(
    "i15_first_last_change",
    f"WITH {HOURLY}, m AS (SELECT symbol, arg_min(close, time) AS f, arg_max(close, time) AS l FROM hourly GROUP BY 1) SELECT symbol, {_MOVE} FROM m",
)
def first_last(spark, folder):
    return A.first_last_change(hourly(spark, folder))


@query(
    "i16_last_vs_previous",
    f"WITH {HOURLY}, m AS (SELECT symbol, close AS l, lag(close) OVER w AS p, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back "
    "FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY time)) SELECT symbol, "
    f"{rx('l', 'last_close')}, {rx('p', 'previous_close')}, {rx('l - p', 'change')}, {rx('(l - p) / nullif(p, 0) * 100', 'change_percent')} FROM m WHERE back = 1",
)
def last_previous(spark, folder):
    return A.last_change(hourly(spark, folder))


@query(
    "i17_range_statistics",
    f"WITH {HOURLY} SELECT symbol, {rx('avg(high - low)', 'avg_range')}, {rx('max(high)', 'period_high')}, {rx('min(low)', 'period_low')}, "
    f"{rx('max(high) - min(low)', 'price_range')} FROM hourly GROUP BY 1",
)
def ranges(spark, folder):
    return A.range_statistics(hourly(spark, folder))


@query(
    "i18_volume_ratio",
    f"WITH {HOURLY} SELECT symbol, {rx('arg_max(volume, time)', 'last_volume')}, {rx('avg(volume)', 'mean_volume')}, "
    + rx("CASE WHEN avg(volume) > 0 THEN arg_max(volume, time) / avg(volume) ELSE 0 END", "volume_ratio")
    + " FROM hourly GROUP BY 1",
)
def volumes(spark, folder):
    return A.volume_ratio(hourly(spark, folder))


@query(
    "i19_trend",
    f"WITH {HOURLY} SELECT symbol, CASE WHEN arg_max(close, time) > arg_min(close, time) THEN 'up' ELSE 'down' END AS trend FROM hourly GROUP BY 1",
)
def trends(spark, folder):
    return A.trend(hourly(spark, folder))


_TYPE = "CASE WHEN abs(close - open) < (high - low) * 0.1::DOUBLE THEN 'Doji' WHEN close > open THEN 'Bullish' ELSE 'Bearish' END"


@query("i20_candle_type", f"WITH {HOURLY} SELECT symbol, time, {_TYPE} AS candle FROM hourly")
def candles(spark, folder):
    return A.with_candle_type(hourly(spark, folder)).select("symbol", "time", "candle")


_PATTERNS = (
    "p AS (SELECT symbol, time, close, open, high, low, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM {source} "
    "WINDOW w AS (PARTITION BY symbol ORDER BY time)), found AS (SELECT symbol, time, close AS price, 'Doji' AS pattern FROM p WHERE high > low AND "
    "abs(close - open) / (high - low) < 0.1::DOUBLE UNION ALL SELECT symbol, time, close, 'Bullish Engulfing' FROM p WHERE close > open AND "
    "pc < po AND open < pc AND close > po UNION ALL SELECT symbol, time, close, 'Bearish Engulfing' FROM p WHERE close < open AND pc > po AND "
    "open > pc AND close < po)"
)


@query(
    "i21_i22_candle_patterns",
    f"WITH {HOURLY}, {_PATTERNS.format(source='hourly')} SELECT symbol, time, {r('price')}, pattern FROM found",
)
def patterns(spark, folder):
    return A.candle_patterns(hourly(spark, folder), by_bars(3600))


@query(
    "i21_i22_recent_patterns",
    f"WITH {HOURLY}, few AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 3), "
    f"{_PATTERNS.format(source='few')} SELECT symbol, time, {r('price')}, pattern FROM found",
)
def late_patterns(spark, folder):
    return A.recent_patterns(hourly(spark, folder))


@query(
    "i23_ohlc_statistics",
    f"WITH {HOURLY} SELECT symbol, count(*) AS bars, min(time) AS first_time, max(time) AS last_time, "
    + ", ".join(rx(f"avg({c})", f"avg_{c}") for c in ("open", "high", "low", "close"))
    + f", {rx('max(high)', 'max_high')}, {rx('min(low)', 'min_low')}, {rx('sum(volume)', 'total_volume')}, {rx('avg(avg_spread)', 'mean_spread')} "
    "FROM hourly GROUP BY 1",
)
def statistics(spark, folder):
    return A.ohlc_statistics(hourly(spark, folder))


def _frames_sql() -> str:
    return (
        f"{HOURLY}, {bars_sql('h4', 'time_bucket(INTERVAL 4 hours, ts)')}, {bars_sql('d1', 'time_bucket(INTERVAL 1 day, ts)')}, "
        "frames AS (SELECT 'H1' AS timeframe, * FROM hourly UNION ALL SELECT 'H4', * FROM h4 UNION ALL SELECT 'D1', * FROM d1)"
    )


def frames(spark, folder):
    ticks = V.ticks(spark, folder)
    made = [B.tick_bars(ticks, t).withColumn("timeframe", F.lit(t)) for t in ("H1", "H4", "D1")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    "i24_timeframe_comparison",
    f"WITH {_frames_sql()}, m AS (SELECT symbol, timeframe, count(*) AS bars, arg_min(close, time) AS f, arg_max(close, time) AS l, "
    "sum(volume) AS total_volume FROM frames GROUP BY 1, 2) SELECT symbol, timeframe, bars, "
    f"{rx('l', 'latest_close')}, {rx('l - f', 'change')}, {rx('CASE WHEN f = 0 THEN 0 ELSE (l - f) / f * 100 END', 'change_percent')}, {r('total_volume')} FROM m",
)
def comparison(spark, folder):
    return A.timeframe_comparison(frames(spark, folder))


@query(
    "i25_timeframe_matrix",
    f"WITH {_frames_sql()}, m AS (SELECT symbol, timeframe, CASE WHEN arg_max(close, time) > arg_min(close, time) THEN 'up' ELSE 'down' END AS a, "
    "printf('%.5f', avg(high - low)) AS b, printf('%.2f', CASE WHEN avg(volume) > 0 THEN arg_max(volume, time) / avg(volume) ELSE 0 END) AS c, "
    "printf('%.5f', max(high) - min(low)) AS d, "
    + _TYPE.replace("close", "arg_max(close, time)").replace("open", "arg_max(open, time)").replace("high", "arg_max(high, time)").replace("low", "arg_max(low, time)")
    + " AS e FROM frames GROUP BY 1, 2), long AS (SELECT symbol, timeframe, 'Trend Direction' AS metric, a AS value FROM m UNION ALL "
    "SELECT symbol, timeframe, 'Volatility', b FROM m UNION ALL SELECT symbol, timeframe, 'Volume Ratio', c FROM m UNION ALL "
    "SELECT symbol, timeframe, 'Price Range', d FROM m UNION ALL SELECT symbol, timeframe, 'Candle Type', e FROM m) "
    "SELECT symbol, metric, max(value) FILTER (timeframe = 'H1') AS H1, max(value) FILTER (timeframe = 'H4') AS H4, "
    "max(value) FILTER (timeframe = 'D1') AS D1 FROM long GROUP BY 1, 2",
)
def matrix(spark, folder):
    return A.timeframe_matrix(frames(spark, folder), ["H1", "H4", "D1"])


@query(
    "i26_spread_distribution",
    f"WITH {USER_TICKS}, s AS (SELECT symbol, ask - bid AS x FROM ticks) SELECT symbol, {rx('min(x)', 'min')}, {rx('max(x)', 'max')}, "
    f"{rx('avg(x)', 'mean')}, {rx('stddev_samp(x)', 'sd')}, {rx('quantile_cont(x, 0.25)', 'q1')}, {rx('quantile_cont(x, 0.5)', 'median')}, "
    f"{rx('quantile_cont(x, 0.75)', 'q3')} FROM s GROUP BY 1",
)
def spreads(spark, folder):
    return A.spread_distribution(V.ticks_by_user(spark, folder))


@query(
    "i27_price_histogram",
    f"WITH {TICKS}, e AS (SELECT min(bid) AS lo, (max(bid) - min(bid)) / 30 AS w FROM ticks), b AS (SELECT CAST(least(floor((bid - lo) / w), 29) AS BIGINT) "
    f"AS bin, lo, w, count(*) AS ticks FROM ticks, e GROUP BY 1, 2, 3) SELECT bin, {rx('lo + bin * w', 'bin_start')}, {rx('lo + (bin + 1) * w', 'bin_end')}, ticks FROM b",
)
def histogram(spark, folder):
    return A.price_histogram(V.ticks(spark, folder))


@query(
    "i28_inventory",
    f"WITH {USER_TICKS}, {bars_sql('d', 'time_bucket(INTERVAL 1 day, ts)')} SELECT symbol, count(*) AS rows, min(time) AS first_time, "
    f"max(time) AS last_time, {rx('arg_max(close, time)', 'latest_close')} FROM d GROUP BY 1",
)
def inventory(spark, folder):
    return A.inventory(B.tick_bars(V.ticks_by_user(spark, folder), "D1"))
