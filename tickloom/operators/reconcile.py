"""Comparison of bars from two sources and of two timeframes. Equality joins on bar time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import resample_ohlc

_FIELDS = ("open", "high", "low", "close")

# Fixed value: the reason given for a bar without counterpart.
NO_COUNTERPART = "No MT5 bar found"


def compare_bars(
    tick_bars: DataFrame,
    broker_bars: DataFrame,
    tolerance: float = 1e-5,
    keys: Sequence[str] = ("symbol", "time"),
) -> DataFrame:
    """Each tick-built bar against the broker's bar of the same time.

    ``accuracy`` = 100 − Σ difference · 10000. A bar without counterpart does
    not match and says why.
    """
    left = tick_bars.select(
        *keys, *[F.col(c).alias(f"t_{c}") for c in _FIELDS], F.col("tick_count").alias("tick_volume_tick")
    )
    right = broker_bars.select(
        *keys,
        *[F.col(c).alias(f"b_{c}") for c in _FIELDS],
        F.col("tick_volume").alias("tick_volume_broker"),
        F.lit(True).alias("found"),
    )
    joined = left.join(right, list(keys), "left").withColumns(
        {f"{c}_diff": F.abs(F.col(f"t_{c}") - F.col(f"b_{c}")) for c in _FIELDS}
    )
    total = sum((F.col(f"{c}_diff") for c in _FIELDS), F.lit(0.0))
    close_enough = F.lit(True)
    for c in _FIELDS:
        close_enough = close_enough & (F.col(f"{c}_diff") <= tolerance)
    return joined.select(
        *keys,
        F.coalesce(close_enough, F.lit(False)).alias("match"),
        *[f"{c}_diff" for c in _FIELDS],
        "tick_volume_tick",
        "tick_volume_broker",
        (F.lit(100.0) - total * 10_000).alias("accuracy"),
        F.when(F.col("found").isNull(), NO_COUNTERPART).alias("reason"),
    )


def reconciliation_summary(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bars compared, matches, match percent, mean accuracy; unmatched bars do not count."""
    out = (
        F.count(F.lit(1)).alias("compared"),
        F.count_if("match").alias("matches"),
        F.try_divide(F.count_if("match") * 100, F.count(F.lit(1))).alias("match_percent"),
        F.avg("accuracy").alias("mean_accuracy"),
    )
    return compared.filter(F.col("reason").isNull()).groupBy(*keys).agg(*out)


def timeframe_consistency(
    fine: DataFrame, coarse: DataFrame, source: str = "M1", target: str = "M5", tolerance: float = 1e-4
) -> DataFrame:
    """Each coarse bar against its fine bars [t, t + target): complete, prices and volume agree."""
    from tickloom import schema as S

    needed = S.TIMEFRAME_MINUTES[S.timeframe(target)] // S.TIMEFRAME_MINUTES[S.timeframe(source)]
    rebuilt = resample_ohlc(fine, source, target).select(
        "symbol",
        "time",
        F.col("high").alias("fine_high"),
        F.col("low").alias("fine_low"),
        F.col("volume").alias("fine_volume"),
        F.col("source_bars").alias("fine_bars"),
    )
    joined = coarse.select("symbol", "time", "high", "low", "volume").join(rebuilt, ["symbol", "time"], "left")
    full = F.coalesce(F.col("fine_bars") == needed, F.lit(False))
    prices = (F.abs(F.col("high") - F.col("fine_high")) < tolerance) & (
        F.abs(F.col("low") - F.col("fine_low")) < tolerance
    )
    return joined.withColumns(
        {
            "fine_bars": F.coalesce("fine_bars", F.lit(0)),
            "is_full": full,
            "price_consistent": F.when(full, prices),
            "volume_consistent": F.when(full, F.abs(F.col("volume") - F.col("fine_volume")) < 1e-6),
        }
    )
