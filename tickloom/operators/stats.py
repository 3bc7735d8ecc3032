"""Cross-symbol and per-symbol statistics of ticks and bars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.functions.candles import candle_type, engulfing, is_doji
from tickloom.functions.scalars import direction, fixed_text
from tickloom.operators.ordered import (
    DEFAULT_BLOCK_ROWS,
    Slicing,
    blocks,
    by_seq,
    last_rows,
    neighbours,
    running,
)
from tickloom.operators.quantiles import exact_quantiles
from tickloom.session import written

KEYS = ["symbol"]


# --- ticks ---------------------------------------------------------------------


def returns(ticks: DataFrame, slicing: Slicing | None = None, column: str = "bid") -> DataFrame:
    """Relative change from the previous tick; the first tick of a symbol is dropped."""
    near = neighbours(ticks, KEYS, slicing or by_seq(), prev={"__prev": column})
    return (
        near.filter(F.col("__prev").isNotNull())
        .withColumn("return", F.try_divide(F.col(column), F.col("__prev")) - 1)
        .drop("__prev")
    )


def price_direction(
    df: DataFrame, columns: Sequence[str], slicing: Slicing, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """up / down / flat against the previous row for each column."""
    near = neighbours(df, keys, slicing, prev={f"__prev_{c}": c for c in columns})
    out = near.withColumns({f"{c}_direction": direction(F.col(c), F.col(f"__prev_{c}")) for c in columns})
    return out.drop(*[f"__prev_{c}" for c in columns])


def rolling_volatility(
    ticks: DataFrame,
    window: int = 10,
    slicing: Slicing | None = None,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Per tick: sample deviation of the last ``window`` returns, annualised, in percent."""
    cut = blocks(ticks.select("symbol", "seq", "bid"), KEYS, slicing or by_seq(), window, block_rows)
    change = F.try_divide(F.col("bid"), F.lag("bid").over(cut.window)) - 1
    stepped = cut.df.withColumn("__return", change)
    value = F.stddev_samp("__return").over(cut.frame(window)) * F.lit(np.sqrt(252.0) * 100)
    out = stepped.withColumn("volatility", cut.full(window + 1, value)).drop("__return")
    return cut.finish(out)


def volatility_summary(rolled: DataFrame) -> DataFrame:
    """Current, average and maximum volatility of symbols that have any."""
    held = rolled.filter(F.col("volatility").isNotNull())
    return held.groupBy("symbol").agg(
        F.max_by("volatility", "seq").alias("current_vol"),
        F.avg("volatility").alias("avg_vol"),
        F.max("volatility").alias("max_vol"),
    )


def normalised_price(ticks: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """bid ÷ the symbol's first bid · 100.

    The first bid reaches each (symbol, slice) as a carried value, so no join on
    the symbol alone is needed.
    """
    held = running(ticks, KEYS, slicing or by_seq(), {"__base": ("first", F.col("bid"))})
    return held.withColumn("normalised", F.try_divide(F.col("bid"), F.col("__base")) * 100).drop("__base")


CELL_SYMBOLS = 256


def _cells(symbols: int) -> int:
    """Parts of the symbols, so that a part holds a few hundred of them."""
    return max(1, -(-symbols // CELL_SYMBOLS))


# Files at most that the vectors of a matrix are read from; every two of them meet in a task.
MATRIX_PARTS = 16
# Pairs that a task hands over at a time.
MATRIX_ROWS = 1 << 18


def _vector_blocks(vectors: DataFrame, parts: int) -> DataFrame:
    """``first, names, vectors``: runs of neighbouring symbols, written in ``parts`` files."""
    size = CELL_SYMBOLS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                names, values = some.column("symbol"), some.column("values").flatten()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, values)]
                yield pa.RecordBatch.from_arrays([names.slice(0, 1), *lists], ["first", "names", "vectors"])

    ordered = vectors.repartitionByRange(parts, "symbol").sortWithinPartitions("symbol")
    return written(ordered.mapInArrow(pack, "first string, names array<string>, vectors array<double>"), "vector-blocks")


def _unit_vectors(flat: pa.ListScalar, symbols: int) -> np.ndarray:
    x = flat.values.to_numpy(zero_copy_only=False).reshape(symbols, -1)
    x = x - x.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pair_matrix(vectors: DataFrame, parts: int) -> DataFrame:
    """Correlation of every two vectors.

    Every two blocks meet in a product of the written table with itself: its files are read by the tasks that need
    them, so no copies of vectors are shuffled. Pairs leave a task some rows of the matrix at a time.
    """

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, others = (batch.column(c)[row].values for c in ("names", "other_names"))
                x = _unit_vectors(batch.column("vectors")[row], len(names))
                y = _unit_vectors(batch.column("other_vectors")[row], len(others))
                same = batch.column("first")[row] == batch.column("other")[row]
                step = max(1, MATRIX_ROWS // len(others))
                for start in range(0, len(names), step):
                    r = (x[start : start + step] @ y.T).ravel()
                    i, j = np.divmod(np.arange(len(r)), len(others))
                    if same:  # a block with itself: each pair once
                        above = np.flatnonzero(j > i + start)
                        r, i, j = r[above], i[above], j[above]
                    value = pa.array(np.clip(r, -1, 1), mask=np.isnan(r))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + start)), others.take(pa.array(j)), value], ["symbol_a", "symbol_b", "r"])

    blocks = _vector_blocks(vectors, parts)
    others = blocks.toDF("other", "other_names", "other_vectors")
    # blocks are ranges of names, so all names of the block with the smaller first one come first
    both = blocks.join(others.hint("shuffle_replicate_nl"), F.col("first") <= F.col("other"))
    pairs = both.mapInArrow(correlate, "symbol_a string, symbol_b string, r double")
    return pairs.coalesce(parts * (parts + 1) // 2)  # the rest of the product is empty


def correlation_matrix(
    ticks: DataFrame, more_than: int = 50, last: int = 100, cells: int | None = None
) -> DataFrame:
    """Pearson r of every two symbols over their last ticks, aligned from the end.

    Symbols need more than ``more_than`` ticks; vectors are cut to the shortest.
    The matrix is the result, so its cells are shared out as a grid of tasks that
    each read the short vectors of two parts of the symbols. The vectors are
    written while this is called, once to be counted and once in blocks.
    """
    recent = last_rows(ticks.select("symbol", "seq", "bid"), KEYS, "seq", max(last, more_than + 1), name="back")
    vectors = (
        recent.groupBy("symbol")
        .agg(F.array_sort(F.collect_list(F.struct("back", "bid"))).alias("tail"))  # at most ``last`` entries
        .filter(F.size("tail") > more_than)
        .select("symbol", F.expr(f"transform(slice(tail, 1, {int(last)}), p -> cast(p.bid as double))").alias("values"))
    )
    vectors = written(vectors, "vectors")
    shortest, symbols = vectors.agg(F.min(F.size("values")), F.count("*")).first()
    vectors = vectors.filter("symbol is not null").select("symbol", F.slice("values", 1, shortest or 1).alias("values"))
    return _pair_matrix(vectors, cells or min(_cells(symbols), MATRIX_PARTS))


def correlation_by_time(
    bars: DataFrame, bucket_bars: int = 4096, cells: int | None = None, time: str = "time", bar_seconds: int = 3600
) -> DataFrame:
    """Pearson r of every two symbols over the bar times they share; null where one of them does not move.

    Bars are cut into runs of ``bucket_bars`` bars of ``bar_seconds``; a task holds one run of two parts of the
    symbols and reports the moments of each pair, which are then added up. Closes are taken as differences from
    the symbol's first close, the same in all runs, so that sums do not cancel.
    """
    cells = cells or _cells(bars.select("symbol").distinct().count())
    first = F.min_by("close", F.when(F.col("close").isNotNull(), F.col(time))).cast("double")
    base = bars.groupBy("symbol").agg(first.alias("__base"))
    bars = bars.select("symbol", time, "close").join(base, "symbol")
    part = F.pmod(F.hash("symbol"), F.lit(cells))
    run = F.floor(F.unix_micros(time) / F.lit(bucket_bars * bar_seconds * 1_000_000)).cast("long")
    other = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    spread = (
        bars.select("symbol", F.unix_micros(time).alias("at"), (F.col("close").cast("double") - F.col("__base")).alias("x"), run.alias("run"), part.alias("part"))
        .withColumn("__other", other)
        .select("symbol", "at", "x", "run", "part", F.least("part", "__other").alias("row"), F.greatest("part", "__other").alias("column"))
    )

    def moments(frame: pd.DataFrame) -> pd.DataFrame:
        row, column = frame["row"].iloc[0], frame["column"].iloc[0]
        wide = frame.pivot(index="at", columns="symbol", values="x").sort_index(axis=1)
        part = frame.groupby("symbol")["part"].first().reindex(wide.columns).to_numpy()
        have = wide.notna().to_numpy().astype("float64")
        x = wide.fillna(0.0).to_numpy()
        n, s, q, p = have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x
        a, b = np.triu_indices(x.shape[1], k=1)
        low, high = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
        mine = (low == row) & (high == column) & (n[a, b] > 0)
        a, b = a[mine], b[mine]
        names = wide.columns.to_numpy()
        return pd.DataFrame(
            {
                "symbol_a": names[a], "symbol_b": names[b], "n": n[a, b],
                "sa": s[a, b], "sb": s[b, a], "qa": q[a, b], "qb": q[b, a], "p": p[a, b],
            }
        )

    sums = (
        spread.groupBy("run", "row", "column")
        .applyInPandas(
            moments,
            "symbol_a string, symbol_b string, n double, sa double, sb double, qa double, qb double, p double",
        )
        .groupBy("symbol_a", "symbol_b")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    )
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    top = n * F.col("p") - sa * sb
    below = F.sqrt(F.greatest(n * F.col("qa") - sa * sa, F.lit(0.0))) * F.sqrt(
        F.greatest(n * F.col("qb") - sb * sb, F.lit(0.0))
    )
    return sums.select("symbol_a", "symbol_b", n.cast("long").alias("n"), F.try_divide(top, below).alias("r"))


def performance(ticks: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Per symbol with two ticks or more: first, last, change, volatility of returns, spreads."""
    near = neighbours(ticks, KEYS, slicing or by_seq(), prev={"__prev": "bid"})
    change = F.try_divide(F.col("bid"), F.col("__prev")) - 1
    spread = F.col("ask") - F.col("bid")
    out = near.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.min_by("bid", "seq").alias("first_price"),
        F.max_by("bid", "seq").alias("last_price"),
        (F.stddev_samp(change) * 100).alias("volatility"),
        F.avg(spread).alias("avg_spread"),
        F.max(spread).alias("max_spread"),
    )
    moved = F.col("last_price") - F.col("first_price")
    return out.filter(F.col("ticks") >= 2).withColumns(
        {"change": moved, "change_percent": F.try_divide(moved, F.col("first_price")) * 100}
    )


def spread_distribution(ticks: DataFrame) -> DataFrame:
    """Box-plot numbers of the spread per symbol, with mean and deviation."""
    spreads = ticks.select("symbol", (F.col("ask") - F.col("bid")).alias("spread"))
    simple = spreads.groupBy("symbol").agg(
        F.min("spread").alias("min"),
        F.max("spread").alias("max"),
        F.avg("spread").alias("mean"),
        F.stddev_samp("spread").alias("sd"),
    )
    return simple.join(exact_quantiles(spreads, KEYS, "spread", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "symbol")


def price_histogram(ticks: DataFrame, bins: int = 30, column: str = "bid") -> DataFrame:
    """Equal-width bins between the smallest and the largest price; empty bins are left out."""
    edges = ticks.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    placed = ticks.select(column, edges.alias("e"))
    lo, hi = F.col("e.lo"), F.col("e.hi")
    width = (hi - lo) / bins
    place = F.coalesce(F.try_divide(F.col(column) - lo, width), F.lit(0.0))
    index = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    return (
        placed.select(index.alias("bin"), lo.alias("lo"), width.alias("width"))
        .groupBy("bin", "lo", "width")
        .agg(F.count(F.lit(1)).alias("ticks"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "ticks",
        )
    )


# --- bars ----------------------------------------------------------------------


def first_last_change(bars: DataFrame, time: str = "time", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    out = bars.groupBy(*keys).agg(
        F.min_by("close", time).alias("first_close"), F.max_by("close", time).alias("last_close")
    )
    moved = F.col("last_close") - F.col("first_close")
    return out.withColumns(
        {
            "change": moved,
            "change_percent": F.when(
                F.col("first_close") == 0, F.lit(0.0)
            ).otherwise(F.try_divide(moved, F.col("first_close")) * 100),
        }
    )


def last_change(bars: DataFrame, time: str = "time", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last close against the one before it."""
    two = last_rows(bars.select(*keys, time, "close"), keys, time, 2, name="back")
    out = two.groupBy(*keys).agg(
        F.max(F.when(F.col("back") == 1, F.col("close"))).alias("last_close"),
        F.max(F.when(F.col("back") == 2, F.col("close"))).alias("previous_close"),
    )
    moved = F.col("last_close") - F.col("previous_close")
    return out.withColumns(
        {"change": moved, "change_percent": F.try_divide(moved, F.col("previous_close")) * 100}
    )


def _trend(first: Column, last: Column) -> Column:
    return F.when(last > first, "up").otherwise("down")


def _volume_ratio(last: Column, mean: Column) -> Column:
    return F.when(mean > 0, last / mean).otherwise(F.lit(0.0))


def range_statistics(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.avg(F.col("high") - F.col("low")).alias("avg_range"),
        F.max("high").alias("period_high"),
        F.min("low").alias("period_low"),
        (F.max("high") - F.min("low")).alias("price_range"),
    )


def volume_ratio(bars: DataFrame, time: str = "time", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    out = bars.groupBy(*keys).agg(
        F.max_by("volume", time).alias("last_volume"), F.avg("volume").alias("mean_volume")
    )
    return out.withColumn("volume_ratio", _volume_ratio(F.col("last_volume"), F.col("mean_volume")))


def trend(bars: DataFrame, time: str = "time", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    out = bars.groupBy(*keys).agg(
        _trend(F.min_by("close", time), F.max_by("close", time)).alias("trend")
    )
    return out


def with_candle_type(bars: DataFrame) -> DataFrame:
    return bars.withColumn("candle", candle_type(F.col("open"), F.col("high"), F.col("low"), F.col("close")))


def candle_patterns(bars: DataFrame, slicing: Slicing, time: str = "time") -> DataFrame:
    """One row per pattern found on any bar: Doji, Bullish / Bearish Engulfing."""
    near = neighbours(
        bars.select("symbol", time, "open", "high", "low", "close"),
        KEYS,
        slicing,
        prev={"__open": "open", "__close": "close"},
    )
    doji = F.when(is_doji(F.col("open"), F.col("high"), F.col("low"), F.col("close")), "Doji")
    swallow = engulfing(F.col("open"), F.col("close"), F.col("__open"), F.col("__close"))
    found = F.explode(F.array_compact(F.array(doji, swallow)))
    return near.select("symbol", time, F.col("close").alias("price"), found.alias("pattern"))


def recent_patterns(bars: DataFrame, n: int = 3, time: str = "time") -> DataFrame:
    """Patterns on the last ``n`` bars of each symbol; the oldest has no neighbour to compare with."""
    from tickloom.operators.ordered import by_time

    few = last_rows(bars, KEYS, time, n)
    return candle_patterns(few, by_time(10**9, time), time)


def ohlc_statistics(bars: DataFrame, time: str = "time") -> DataFrame:
    out = [
        F.count(F.lit(1)).alias("bars"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("open", "high", "low", "close")],
        F.max("high").alias("max_high"),
        F.min("low").alias("min_low"),
        F.sum("volume").alias("total_volume"),
    ]
    if "avg_spread" in bars.columns:
        out.append(F.avg("avg_spread").alias("mean_spread"))
    return bars.groupBy("symbol").agg(*out)


def timeframe_comparison(bars: DataFrame, time: str = "time") -> DataFrame:
    """Rows, latest close, change, change percent and volume by symbol and timeframe."""
    keys = ["symbol", "timeframe"]
    out = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by("close", time).alias("__first"),
        F.max_by("close", time).alias("latest_close"),
        F.sum("volume").alias("total_volume"),
    )
    moved = F.col("latest_close") - F.col("__first")
    return out.withColumns(
        {
            "change": moved,
            "change_percent": F.when(F.col("__first") == 0, F.lit(0.0)).otherwise(
                F.try_divide(moved, F.col("__first")) * 100
            ),
        }
    ).drop("__first")


def timeframe_matrix(
    bars: DataFrame, timeframes: Sequence[str] = ("M1", "M5", "M15", "H1", "H4", "D1"), time: str = "time"
) -> DataFrame:
    """Metric rows × timeframe columns, per symbol; ``N/A`` where a timeframe has fewer than two bars.

    Values are bare numbers and words; units and arrows are left to display.
    """
    facts = bars.groupBy("symbol", "timeframe").agg(
        _trend(F.min_by("close", time), F.max_by("close", time)).alias("trend"),
        F.avg(F.col("high") - F.col("low")).alias("avg_range"),
        _volume_ratio(F.max_by("volume", time), F.avg("volume")).alias("volume_ratio"),
        (F.max("high") - F.min("low")).alias("price_range"),
        candle_type(
            F.max_by("open", time), F.max_by("high", time), F.max_by("low", time), F.max_by("close", time)
        ).alias("candle"),
        F.count(F.lit(1)).alias("bars"),
    )
    enough = lambda value: F.when(F.col("bars") >= 2, value).otherwise("N/A").alias("value")
    long = facts.select(
        "symbol",
        "timeframe",
        F.inline(
            F.array(
                F.struct(F.lit("Trend Direction").alias("metric"), enough(F.col("trend"))),
                F.struct(F.lit("Volatility").alias("metric"), enough(fixed_text(F.col("avg_range"), 5))),
                F.struct(F.lit("Volume Ratio").alias("metric"), enough(fixed_text(F.col("volume_ratio"), 2))),
                F.struct(F.lit("Price Range").alias("metric"), enough(fixed_text(F.col("price_range"), 5))),
                F.struct(F.lit("Candle Type").alias("metric"), enough(F.col("candle"))),
            )
        ),
    )
    names = [S.timeframe(t) for t in timeframes]
    return long.groupBy("symbol", "metric").pivot("timeframe", names).agg(F.first("value"))


def inventory(bars: DataFrame, time: str = "time", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.max_by("close", time).alias("latest_close"),
    )
