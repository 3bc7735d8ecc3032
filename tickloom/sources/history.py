"""Bar history: raw rates, range scans and the merge of overlapping extracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.gaps import detect_missing_periods
from tickloom.sources.ticks import in_range


def raw_to_ohlc(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Source rates (epoch seconds) to the fetched layout; ``keep`` passes key columns through."""
    return raw.select(
        *keep,
        F.timestamp_seconds("time").alias("timestamp"),
        *[F.col(c).cast("float").alias(c) for c in ("open", "high", "low", "close")],
        F.col("tick_volume").cast("float").alias("volume"),
        F.col("spread").cast("int").alias("spread"),
    )


def merge_extracts(
    extracts: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "timeframe"), time: str = "timestamp"
) -> DataFrame:
    """One row per key and time out of overlapping extracts; earlier extracts win.

    ``min`` over (extract number, values) is combined on the map side, so any
    number of copies of one row is reduced before the shuffle, and the choice
    between equal copies does not depend on row order.
    """
    ranked = [
        df.select(*keys, time, F.struct(F.lit(i).alias("rank"), *[c for c in df.columns if c not in (*keys, time)]).alias("row"))
        for i, df in enumerate(extracts)
    ]
    values = [c for c in extracts[0].columns if c not in (*keys, time)]
    merged = reduce(DataFrame.unionByName, ranked).groupBy(*keys, time).agg(F.min("row").alias("row"))
    return merged.select(*keys, time, *[F.col(f"row.{c}").alias(c) for c in values])


def fetch_ohlc_data(
    bars: DataFrame,
    symbol: str,
    timeframe: str,
    start,
    end,
    detect_gaps: bool = True,
    limit: int | None = None,
    time: str = "timestamp",
) -> tuple[DataFrame, DataFrame | None]:
    """(bars, missing periods) of one symbol and timeframe, one row per time, oldest first.

    Filters on symbol, timeframe and time reach the scan (partition pruning on a
    partitioned table). Nothing found gives zero rows with the full layout.
    """
    tf = S.timeframe(timeframe)
    mine = bars.filter((F.col("symbol") == symbol.upper()) & (F.col("timeframe") == tf))
    found = merge_extracts([in_range(mine, start, end, time)], time=time)
    missing = detect_missing_periods(found, tf, ("symbol", "timeframe"), time) if detect_gaps else None
    rows = found.orderBy(time)
    return (rows.limit(limit) if limit is not None else rows), missing
