"""Streaming bars and rates on event time with the built-in window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema as S


def read_ticks(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.ARRIVED_TICK,
    files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """A tick stream from parquet files dropped into a folder; the symbol is a column.

    ``files_per_trigger`` is the admission control: a slow consumer takes smaller
    bites, nothing is dropped.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def windowed_bars(stream: DataFrame, seconds: int = 60, *, delay: str) -> DataFrame:
    """Tumbling bars. In append mode a bar appears once, after the watermark passes its end;
    in update mode the unfinished bar is visible too.

    The watermark is shared by all symbols: ticks more than ``delay`` behind the
    fastest symbol are dropped, so ``delay`` must cover how far symbols and files
    get out of step. ``sinks.dropped_rows`` tells how many were dropped. Use
    ``stateful.clean_bars`` where a bar must close by its own symbol's ticks only.
    """
    window = F.window("ts", f"{seconds} seconds")
    bars = (
        stream.withWatermark("ts", delay)
        .groupBy("symbol", window)
        .agg(
            F.min_by("bid", "seq").alias("open"),
            F.max("bid").alias("high"),
            F.min("bid").alias("low"),
            F.max_by("bid", "seq").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("tick_count"),
            F.avg(F.col("ask") - F.col("bid")).alias("avg_spread"),
        )
    )
    return bars.select(
        "symbol",
        F.col("window.start").alias("time"),
        (F.col("window.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("end_time"),
        *[c for c in bars.columns if c not in ("symbol", "window")],
    )


def sliding_rates(
    stream: DataFrame, seconds: int = 10, step: int = 1, *, delay: str
) -> DataFrame:
    """Ticks per second per symbol over windows of ``seconds`` that start every ``step``.

    ``delay`` as in ``windowed_bars``.
    """
    window = F.window("ts", f"{seconds} seconds", f"{step} seconds")
    counted = (
        stream.withWatermark("ts", delay).groupBy("symbol", window).agg(F.count(F.lit(1)).alias("ticks"))
    )
    return counted.select(
        "symbol",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "ticks",
        (F.col("ticks") / F.lit(float(seconds))).alias("ticks_per_second"),
    )
