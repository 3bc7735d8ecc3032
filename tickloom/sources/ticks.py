"""Tick sources: raw rows to ticks, range scans, cursors, recent rows, micro-batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import Slicing, by_seq, last_rows, running, with_position


class UnknownSymbol(ValueError):
    """The requested symbol has no rows."""


def raw_to_ticks(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """Source ticks (epoch seconds) to the tick layout; missing volume is 0."""
    name = F.lit(symbol) if isinstance(symbol, str) else symbol
    micros = F.round(F.col("time") * 1_000_000).cast("long")
    return raw.select(
        F.timestamp_micros(micros).alias("timestamp"),
        F.upper(name).alias("symbol"),
        F.col("bid").cast("float").alias("bid"),
        F.col("ask").cast("float").alias("ask"),
        F.coalesce(F.col("volume").cast("float"), F.lit(0.0).cast("float")).alias("volume"),
    )


def _literal(at: datetime | str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def in_range(df: DataFrame, start, end, time: str = "ts") -> DataFrame:
    """Inclusive time range; instants without zone are UTC (the session's zone)."""
    return df.filter(F.col(time).between(_literal(start), _literal(end)))


def fetch_tick_data(
    ticks: DataFrame, symbol: str, start, end, limit: int | None = None, time: str = "ts", check: bool = True
) -> DataFrame:
    """Ticks of one symbol in a time range, oldest first.

    The time range reaches the scan, and so does the symbol where it is a stored
    column. An unknown symbol is an error, which costs a look for it first.
    """
    mine = ticks.filter(F.col("symbol") == symbol.upper())
    if check and mine.isEmpty():
        raise UnknownSymbol(f"unknown symbol {symbol!r}")
    found = in_range(mine, start, end, time).orderBy(time, *(["seq"] if "seq" in ticks.columns else []))
    return found.limit(limit) if limit is not None else found


def list_symbols(df: DataFrame, limit: int | None = None, visible: Column | None = None) -> DataFrame:
    """Distinct symbols in order; ``visible`` keeps the rows whose symbol is shown."""
    chosen = df.filter(visible) if visible is not None else df
    names = chosen.select("symbol").distinct().orderBy("symbol")
    return names.limit(limit) if limit is not None else names


def new_ticks(ticks: DataFrame, cursor: DataFrame | None, start_seq: int = -1) -> DataFrame:
    """Ticks after a reader's cursor (symbol, last_seq); a symbol without cursor is new.

    The cursor is the table saved after the last read: one row per symbol.
    """
    if cursor is None:
        return ticks.filter(F.col("seq") > start_seq)
    joined = ticks.join(cursor.select("symbol", "last_seq"), "symbol", "left")
    return joined.filter(F.col("seq") > F.coalesce("last_seq", F.lit(start_seq))).drop("last_seq")


def advance_cursor(read: DataFrame) -> DataFrame:
    """The cursor after ``read`` was delivered."""
    return read.groupBy("symbol").agg(F.max("seq").alias("last_seq"))


def recent_ticks(ticks: DataFrame, n: int = 10_000) -> DataFrame:
    """The last ``n`` ticks of each symbol by arrival (fewer when there are fewer)."""
    return last_rows(ticks, ["symbol"], "seq", n)


def arrival_batches(ticks: DataFrame, size: int = 100, slicing: Slicing | None = None) -> DataFrame:
    """Per symbol and run of ``size`` arrivals: rows, first and last time, lowest and highest bid,
    and the lowest and highest bid so far."""
    slicing = slicing or by_seq()
    numbered = with_position(ticks, ["symbol"], slicing)
    batches = (
        numbered.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))
        .groupBy("symbol", "batch")
        .agg(
            F.count(F.lit(1)).alias("ticks"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min("bid").alias("min_bid"),
            F.max("bid").alias("max_bid"),
        )
    )
    return running(
        batches,
        ["symbol"],
        by_seq(1 << 16, "batch"),
        {"running_min": ("min", F.col("min_bid")), "running_max": ("max", F.col("max_bid"))},
    )
