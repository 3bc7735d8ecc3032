"""Headline queries timed on local cores; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion into a sink that discards its rows, after one
warm-up run of the session; the best of three runs counts.
"""

from __future__ import annotations

import json
import os
import time

from tickloom.operators import bars, clean, gaps, indicators, reconcile, stats, validate
from tickloom.session import local_session, remove_written
from tickloom.sources import fx_views as V
from tickloom.streaming import bars as streams
from tickloom.streaming import sinks

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def cases(spark):
    ticks = lambda: V.ticks(spark, FOLDER)
    many = lambda: V.ticks_by_user(spark, FOLDER)
    lines = lambda: V.lineitem_ticks(spark, FOLDER)
    hourly = lambda: bars.tick_bars(ticks(), "H1")
    daily = lambda: bars.tick_bars(lines(), "D1")
    # a million M1 bars of one symbol, with an hour missing in every 5,000
    minutes = lambda: (
        spark.range(1_000_000)
        .filter("id % 300000 >= 60")
        .selectExpr(
            "'EURUSD' AS symbol",
            "timestamp_seconds(1577836800 + id * 60) AS time",
            "1.1 + 0.01 * sin(id / 500) AS close",
        )
    )
    # the ticks as twenty files with symbols in step, admitted five at a time
    arrived = f"{sinks.stream_folder(spark, 'bench')}/in"
    ticks().repartitionByRange(20, "seq").write.parquet(arrived)
    stream = lambda: streams.read_ticks(spark, arrived, ticks().schema, files_per_trigger=5)
    return {
        "tick_bars_h1": lambda: hourly(),
        "tick_bars_many_symbols": lambda: bars.tick_bars(many(), "H1"),
        "tick_bars_lineitem_d1": lambda: daily(),
        "validate_ticks": lambda: validate.validate_ticks(ticks()),
        "drop_reversals": lambda: clean.accepted_ticks(V.shuffled_ticks(spark, FOLDER)),
        "tick_gaps": lambda: clean.tick_gaps(ticks(), 3600.0),
        "tick_gaps_lineitem": lambda: clean.tick_gaps(lines(), 3600.0, V.LINEITEM_DAYS),
        "spike_filter": lambda: clean.flag_spikes(ticks(), 50.0, 3600.0),
        "zscore_1000": lambda: clean.zscore_flags(ticks()),
        "trailing_rate": lambda: clean.trailing_rate(ticks(), 3600, 3600.0, "rate"),
        "sma_bollinger": lambda: indicators.calculate_indicators(hourly(), ["sma", "bollinger"]),
        "ema": lambda: indicators.ema(hourly()),
        "rsi_macd": lambda: indicators.calculate_indicators(hourly(), ["rsi", "macd"]),
        "missing_periods": lambda: gaps.detect_missing_periods(daily(), "D1"),
        "fill_gaps": lambda: gaps.fill_gaps(hourly(), "H1", "linear"),
        "volatility": lambda: stats.volatility_summary(stats.rolling_volatility(ticks())),
        "spread_quantiles": lambda: stats.spread_distribution(many()),
        "correlation_matrix": lambda: stats.correlation_matrix(many()),
        "reconcile": lambda: reconcile.reconciliation_summary(
            reconcile.compare_bars(hourly(), bars.broker_bars(ticks(), "H1")), ["symbol"]
        ),
        "million_m1_gaps": lambda: gaps.detect_missing_periods(minutes(), "M1"),
        "million_m1_indicators": lambda: indicators.calculate_indicators(minutes(), ["sma", "ema", "rsi"]),
        "million_m1_rci": lambda: indicators.rci(minutes()),
        "stream_bars": lambda: sinks.drain(
            streams.windowed_bars(stream(), 3600, delay="1 hour"), sinks.stream_folder(spark, "bench")
        ),
        "patterns": lambda: stats.candle_patterns(hourly(), bars.by_bars(3600)),
    }


def run(make) -> float:
    started = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    work = cases(spark)
    run(work["tick_bars_h1"])
    run(work["ema"])  # starts the Python workers
    seconds = {name: round(min(run(make) for _ in range(3)), 4) for name, make in work.items()}
    events = V.read_table(spark, FOLDER, "events").count()
    lines = V.read_table(spark, FOLDER, "lineitem").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
                "rows": {"events": events, "lineitem": lines},
                "rows_per_second": {
                    "ticks_to_bars_5_symbols": round(events / seconds["tick_bars_h1"]),
                    "ticks_to_bars_many_symbols": round(events / seconds["tick_bars_many_symbols"]),
                    "ticks_to_bars_lineitem": round(lines / seconds["tick_bars_lineitem_d1"]),
                    "stream_bars": round(events / seconds["stream_bars"]),
                    "million_m1_gaps": round(999_760 / seconds["million_m1_gaps"]),
                    "million_m1_rci": round(999_760 / seconds["million_m1_rci"]),
                    "million_m1_indicators": round(999_760 / seconds["million_m1_indicators"]),
                    "tick_gap_detection_lineitem": round(lines / seconds["tick_gaps_lineitem"]),
                },
            }
        )
    )
    remove_written(spark)
    spark.stop()


if __name__ == "__main__":
    main()
