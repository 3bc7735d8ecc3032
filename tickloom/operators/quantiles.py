"""Exact quantiles without gathering a key's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import _EDGE, _SLICE, _inside, _scan
from pyspark.sql import Window


def _value_slice(value: Column, steps: int = 1024) -> Column:
    """A slice number that never falls as ``value`` rises: octave times ``steps`` plus the place in it."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    place = F.floor(((octave - 1) + size / F.pow(F.lit(2.0), octave)) * steps) + 1100 * steps
    return F.when(value > 0, place).when(value < 0, -place).otherwise(F.lit(0)).cast("long")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per key (the definition of ``percentile``).

    Equal values are counted first, so copies collapse on the map side; the
    running count is carried over value slices, so a key is spread over tasks.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(_SLICE, _value_slice(F.col("__x")))
    )
    scan = _scan(keys)
    carry = (
        counted.groupBy(*keys, _SLICE)
        .agg(F.sum("__n").alias("__n"))
        .select(
            *keys,
            _SLICE,
            F.lit(-1).alias(_EDGE),
            F.sum("__n").over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("__n"),
            F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
        )
    )
    both = counted.withColumn(_EDGE, F.lit(0)).unionByName(carry, allowMissingColumns=True)
    inside = _inside(keys, "__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.select(
        *keys,
        "__x",
        _EDGE,
        "__n",
        F.sum("__n").over(inside).alias("__upto"),
        F.max("__total").over(inside).alias("__rows"),
    ).filter(F.col(_EDGE) == 0)
    # Row r (0-based) of the key is this value when upto - n <= r < upto.
    first = F.col("__upto") - F.col("__n")
    picks = []
    for name, p in probabilities.items():
        target = (F.col("__rows") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            hit = (rank >= first) & (rank < F.col("__upto"))
            picks.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{side}_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("__rows").alias("__rows"), *picks)
    out = []
    for name, p in probabilities.items():
        target = (F.col("__rows") - 1) * F.lit(float(p))
        share = target - F.floor(target)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (high - low) * share).alias(name))
    return found.select(*keys, *out)
