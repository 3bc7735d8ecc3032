"""Ordered computation per key that never puts one key in one task.

A plain ``Window.partitionBy(symbol).orderBy(seq)`` sorts a symbol's whole
history in a single task, which fails as soon as one symbol owns a large share
of the ticks. Everything here cuts a key's history into bounded runs instead:

* a *slice* is a range of the order column (arrival numbers or time), of fixed
  width or, with ``equal_depth``, of about equally many rows.
  What a row needs from before its slice is summarised per (key, slice) by an
  ordinary map-side-combined aggregate, scanned over the tiny summary, and
  handed to the slice as one extra *carry row*. The data itself is shuffled
  once, by (key, slice), and sorted once.
* a *block* is a fixed number of consecutive rows, plus a halo with the rows a
  bounded frame looks back to. Rows are in at most two blocks.

The order column must be unique per key (arrival number, or the bar time).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import written

DEFAULT_SLICE_ROWS = 1 << 20
DEFAULT_BLOCK_ROWS = 1 << 16
# Blocks whose states are scanned in one task.
SCAN_GROUP = 1024

_SLICE, _EDGE, _POS, _BLOCK, _OWN, _STATE, _GROUP = "__slice", "__edge", "__pos", "__block", "__own", "__state", "__group"


@dataclass(frozen=True)
class Slicing:
    """Order column and the width of one slice in that column's units."""

    order: str
    width: int
    is_time: bool = False

    def column(self) -> Column:
        value = F.unix_micros(F.col(self.order).cast("timestamp")) if self.is_time else F.col(self.order)
        return F.floor(value / F.lit(self.width)).cast("long")

    @property
    def single(self) -> bool:
        """Whether it is known that no key has two slices."""
        return False

    @property
    def cut_keys(self) -> DataFrame | None:
        """The keys that may have two slices, where they are known without reading rows."""
        return None

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of each row's slice."""
        return df.withColumn(_SLICE, self.column())


@dataclass(frozen=True)
class EqualDepth(Slicing):
    """Slices of about equally many rows per key, however its rows are spread over the order column.

    ``bounds`` has a row per key that needs more than one slice: the values at which its slices end, in order. A row's
    slice is the number of bounds below it, found by halving, one projection per step.
    """

    bounds: DataFrame | None = None
    keys: tuple[str, ...] = ()
    most: int = 0  # bounds of a key, at most

    @property
    def single(self) -> bool:
        return not self.most

    @property
    def cut_keys(self) -> DataFrame | None:
        return None if self.bounds is None else self.bounds.select(*self.keys)

    def cut(self, df: DataFrame) -> DataFrame:
        if not self.most:
            return df.withColumn(_SLICE, F.when(F.col(self.order).isNotNull(), F.lit(0).cast("long")))
        value = F.unix_micros(F.col(self.order).cast("timestamp")) if self.is_time else F.col(self.order)
        of_key = self.bounds.select(*[F.col(k).alias(f"__of_{k}") for k in self.keys], F.col("bounds").alias("__bounds"))
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
        joined = df.join(of_key, same, "left").withColumn("__at", F.lit(0))
        step = 1 << (self.most.bit_length() - 1)
        while step:
            beyond = F.coalesce(F.get("__bounds", F.col("__at") + F.lit(step - 1)) < value, F.lit(False))
            joined = joined.withColumn("__at", F.col("__at") + F.when(beyond, step).otherwise(0))
            step //= 2
        return joined.select(*df.columns, F.when(value.isNotNull(), F.col("__at").cast("long")).alias(_SLICE))


def by_seq(width: int = DEFAULT_SLICE_ROWS, order: str = "seq") -> Slicing:
    """Slices of ``width`` arrival numbers; for numbers without large holes (else ``measured``)."""
    return Slicing(order, width)


def measured(
    df: DataFrame, order: str = "seq", rows: int = DEFAULT_SLICE_ROWS, keys: Sequence[str] = ("symbol",)
) -> Slicing:
    """Slices that hold about ``rows`` rows of the densest key.

    Arrival numbers with holes (several feeds in one counter, time stamps used as
    numbers) would leave fixed slices nearly empty. One narrow aggregate finds how
    many rows a key has per unit of the order column; where every key is sparse
    the slices become wide, and a light key is a single slice.
    """
    column = F.col(order)
    is_time = dict(df.dtypes)[order].startswith(("timestamp", "date"))
    if is_time:
        column = F.unix_micros(column.cast("timestamp"))
    held = [k for k in keys if k in df.columns]
    per_key = df.groupBy(*held).agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")
    )
    span = F.col("hi") - F.col("lo") + 1
    densest = per_key.agg(F.max(F.col("n") / span).alias("density"), F.max(span).alias("span")).first()
    if not densest["density"]:
        return Slicing(order, rows, is_time)
    width = min(rows / densest["density"], float(densest["span"]) + 1)
    return Slicing(order, min(max(int(width), 1), 1 << 62), is_time)


# Slices of a key at most: beyond, slices hold more rows.
MOST_SLICES = 4096


def equal_depth(
    df: DataFrame, order: str = "seq", rows: int = DEFAULT_SLICE_ROWS, keys: Sequence[str] = ("symbol",)
) -> EqualDepth:
    """Slices that hold about ``rows`` rows of a key wherever its rows are dense.

    A burst (most ticks of a day in some minutes) falls into one slice of fixed
    width. Here bounds are quantiles of the order column from mergeable summaries,
    exact to a twentieth of a slice; a key of up to ``rows`` rows is one slice, and a
    key has ``MOST_SLICES`` at most. Two narrow aggregates run while this is called.
    """
    is_time = dict(df.dtypes)[order].startswith(("timestamp", "date"))
    value = F.unix_micros(F.col(order).cast("timestamp")) if is_time else F.col(order).cast("long")
    held = [k for k in keys if k in df.columns]
    counts = df.groupBy(*held).agg(F.count(order).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    parts = min(-(-largest // rows), MOST_SLICES)
    if parts < 2:
        return EqualDepth(order, rows, is_time, None, tuple(held), 0)
    # as text: a list becomes a literal per call, and thousands of them take seconds
    cuts = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    found = df.withColumn("__at", value).groupBy(*held)
    found = found.agg(F.count(order).alias("n"), F.expr(f"percentile_approx(__at, array({cuts}), {20 * parts})").alias("cuts"))
    # a key with fewer rows takes every so many cuts of the largest one
    mine = F.greatest(F.lit(1), F.least(F.lit(parts), F.ceil(F.col("n") / rows))).cast("int")
    each = F.floor(F.lit(parts) / mine).cast("int")
    some = F.array_distinct(F.filter("cuts", lambda x, i: (i + 1) % F.col("each") == 0))
    bounds = found.withColumn("mine", mine).withColumn("each", each).filter("mine > 1")
    bounds = written(bounds.select(*held, some.alias("bounds")), "slice-bounds")
    most = bounds.agg(F.max(F.size("bounds"))).first()[0] or 0
    return EqualDepth(order, rows, is_time, bounds, tuple(held), most)


def by_time(seconds: int, order: str = "time") -> Slicing:
    """Slices of ``seconds`` of event time."""
    return Slicing(order, seconds * 1_000_000, True)


def by_bars(bar_seconds: int, order: str = "time", bars: int = DEFAULT_BLOCK_ROWS) -> Slicing:
    """Slices that hold at most ``bars`` bars of ``bar_seconds`` each."""
    return by_time(bar_seconds * bars, order)


def _sliced(df: DataFrame, slicing: Slicing) -> DataFrame:
    return slicing.cut(df)


def _scan(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(_SLICE)


def _inside(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys, _SLICE).orderBy(_EDGE, order)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    slicing: Slicing,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
) -> DataFrame:
    """Add values of the previous / next row of the same key.

    ``prev={"last_close": "close"}`` adds ``last_close`` = lag(close), and
    ``next`` does the same with lead.
    """
    prev, next = prev or {}, next or {}
    order = slicing.order
    data = _sliced(df, slicing)
    before, after = sorted(set(prev.values())), sorted(set(next.values()))
    ends = data.groupBy(*keys, _SLICE).agg(
        *[F.max_by(c, order).alias(f"__last_{c}") for c in before],
        *[F.min_by(c, order).alias(f"__first_{c}") for c in after],
    )
    scan = _scan(keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    used = sorted(set(before) | set(after))
    rows = []
    if before:
        rows.append(
            F.struct(
                F.lit(-1).alias(_EDGE),
                *[
                    (F.col(f"__before_{c}") if c in before else F.lit(None).cast(types[c])).alias(c)
                    for c in used
                ],
            )
        )
    if after:
        rows.append(
            F.struct(
                F.lit(1).alias(_EDGE),
                *[
                    (F.col(f"__after_{c}") if c in after else F.lit(None).cast(types[c])).alias(c)
                    for c in used
                ],
            )
        )
    carry = ends.select(
        *keys,
        _SLICE,
        *[F.lag(f"__last_{c}").over(scan).alias(f"__before_{c}") for c in before],
        *[F.lead(f"__first_{c}").over(scan).alias(f"__after_{c}") for c in after],
    ).select(*keys, _SLICE, F.inline(F.array(*rows)))
    both = data.withColumn(_EDGE, F.lit(0)).unionByName(carry, allowMissingColumns=True)
    inside = _inside(keys, order)
    both = both.select(
        "*",
        *[F.lag(c).over(inside).alias(name) for name, c in prev.items()],
        *[F.lead(c).over(inside).alias(name) for name, c in next.items()],
    )
    return both.filter(F.col(_EDGE) == 0).drop(_EDGE, _SLICE)


_FOLDS: dict[str, Callable[[Column], Column]] = {
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "first": lambda c: F.first(c, ignorenulls=True),
}


def _first_held(value: str, order: str) -> Column:
    """The first value that is not null; the frame inside a slice skips nulls too."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    slicing: Slicing,
    folds: dict[str, tuple[str, Column]],
    include_current: bool = True,
) -> DataFrame:
    """Running max / min / sum / first per key, with or without the current row.

    ``folds={"latest": ("max", F.col("ts"))}``.
    """
    order = slicing.order
    data = _sliced(df, slicing).select("*", *[v.alias(f"__v_{n}") for n, (_, v) in folds.items()])
    scan = _scan(keys).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = data.groupBy(*keys, _SLICE).agg(
        *[
            (_first_held(f"__v_{n}", order) if f == "first" else _FOLDS[f](F.col(f"__v_{n}"))).alias(f"__v_{n}")
            for n, (f, _) in folds.items()
        ]
    )
    carry = per_slice.select(
        *keys,
        _SLICE,
        F.lit(-1).alias(_EDGE),
        *[_FOLDS[f](F.col(f"__v_{n}")).over(scan).alias(f"__v_{n}") for n, (f, _) in folds.items()],
    )
    both = data.withColumn(_EDGE, F.lit(0)).unionByName(carry, allowMissingColumns=True)
    inside = _inside(keys, order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if include_current else -1
    )
    both = both.select(
        *df.columns,
        _EDGE,
        *[_FOLDS[f](F.col(f"__v_{n}")).over(inside).alias(n) for n, (f, _) in folds.items()],
    )
    return both.filter(F.col(_EDGE) == 0).drop(_EDGE)


def nearest(
    df: DataFrame,
    keys: Sequence[str],
    slicing: Slicing,
    value: Column,
    name: str,
    direction: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest non-null ``value`` at or before a row, or earliest at or after it.

    ``direction`` is ``"backward"`` or ``"forward"``. Rows with equal order
    values are arranged by the ``tie`` columns.
    """
    forward = direction == "forward"
    order = slicing.order
    data = _sliced(df, slicing).withColumn("__value", value)
    held = data.filter(F.col("__value").isNotNull())
    rank = F.struct(order, *tie)
    pick = F.min_by if forward else F.max_by
    per_slice = data.select(*keys, _SLICE).distinct().join(
        held.groupBy(*keys, _SLICE).agg(pick("__value", rank).alias("__value")),
        [*keys, _SLICE],
        "left",
    )
    # a frame that ends at a fixed row is computed anew for each row; looking ahead is looking back in reversed order
    scan = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(_SLICE) if forward else F.asc_nulls_first(_SLICE))
    found = F.last("__value", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1))
    carry = per_slice.select(
        *keys, _SLICE, F.lit(1 if forward else -1).alias(_EDGE), found.alias("__value")
    )
    both = data.withColumn(_EDGE, F.lit(0)).unionByName(carry, allowMissingColumns=True)
    along = [F.desc_nulls_last(c) if forward else F.asc_nulls_first(c) for c in (_EDGE, order, *tie)]
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("__value", ignorenulls=True).over(inside)
    return both.select(*df.columns, _EDGE, hit.alias(name)).filter(F.col(_EDGE) == 0).drop(_EDGE)


def with_position(
    df: DataFrame, keys: Sequence[str], slicing: Slicing, name: str = "position"
) -> DataFrame:
    """Number the rows of each key 1, 2, 3, … in order."""
    return running(df, keys, slicing, {name: ("sum", F.lit(1).cast("long"))})


@dataclass(frozen=True)
class Blocks:
    """Rows cut into equal blocks, with halo rows in front of each block."""

    df: DataFrame
    keys: tuple[str, ...]
    window: WindowSpec
    position: Column

    def frame(self, rows: int) -> WindowSpec:
        """The last ``rows`` rows, current one included."""
        return self.window.rowsBetween(-(rows - 1), 0)

    def full(self, rows: int, value: Column) -> Column:
        """``value``, or null until ``rows`` rows exist."""
        return F.when(self.position >= rows, value)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the halo rows and the bookkeeping columns."""
        return df.filter(F.col(_OWN)).drop(_OWN, _POS, _BLOCK)


def blocks(
    df: DataFrame,
    keys: Sequence[str],
    slicing: Slicing,
    lookback: int,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> Blocks:
    """Prepare ``df`` for frames that look back at most ``lookback`` rows."""
    size = max(block_rows, lookback + 1)
    numbered = with_position(df, keys, slicing, _POS)
    index, offset = F.floor((F.col(_POS) - 1) / size), (F.col(_POS) - 1) % size
    home = index.cast("long")
    # The tail of a block is also the halo of the block behind it.
    homes = F.when(offset >= size - lookback, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("__home", home).withColumn(_BLOCK, F.explode(homes))
    spread = spread.withColumn(_OWN, F.col(_BLOCK) == F.col("__home")).drop("__home")
    window = Window.partitionBy(*keys, _BLOCK).orderBy(_POS)
    return Blocks(spread, tuple(keys), window, F.col(_POS))


def ordered_by(table: pa.Table, column: str) -> pa.Table:
    """The rows of one group in order (a group's rows arrive in any order)."""
    at = table.column(column).to_numpy()
    return table if (at[1:] >= at[:-1]).all() else table.take(np.argsort(at, kind="stable"))


def _scanned(sums: DataFrame, keys: Sequence[str], combine: Callable, merge: Callable, size: int) -> DataFrame:
    """The state in front of every block, from the numbers of the blocks; ``size`` blocks are a group of their own."""
    groups = [*keys, _GROUP]
    grouped = sums.withColumn(_GROUP, F.floor(F.col(_BLOCK) / size).cast("long"))
    states = pa.list_(pa.float64())
    names = {field.name: field for field in grouped.schema.fields}
    totals = T.StructType([names[c] for c in [*groups, _STATE]])

    def total(table: pa.Table) -> pa.Table:
        numbers = None
        for block in ordered_by(table, _BLOCK).column(_STATE).to_pylist():
            numbers = block if numbers is None else merge(numbers, block)
        return table.slice(0, 1).select(groups).append_column(_STATE, pa.array([numbers], states))

    def through(table: pa.Table, order: str, state: list | None) -> pa.Table:
        table = ordered_by(table, order)
        before = []
        for numbers in table.column(_STATE).to_pylist():
            before.append(state)
            state = combine(state, numbers)
        return table.set_column(table.column_names.index(_STATE), _STATE, pa.array(before, states))

    def within(table: pa.Table, start: pa.Table) -> pa.Table:
        return through(table, _BLOCK, start.column(_STATE)[0].as_py()).select([*keys, _BLOCK, _STATE])

    of_groups = grouped.groupBy(*groups).applyInArrow(total, totals)
    of_groups = of_groups.groupBy(*keys).applyInArrow(lambda table: through(table, _GROUP, None).select([*groups, _STATE]), totals)
    return grouped.groupBy(*groups).cogroup(of_groups.groupBy(*groups)).applyInArrow(within, sums.schema)


def fold_blocks(
    cut: Blocks,
    fold: Callable,
    uses: Sequence[str],
    added: Sequence[T.StructField],
    summary: Callable | None = None,
    combine: Callable | None = None,
    merge: Callable | None = None,
) -> DataFrame:
    """Run a function over each block (rows in order, halo in front).

    ``fold(frame, state)`` sees the ``uses`` columns, ``__pos``, the row's number in
    its key, and ``__own``, false for halo rows, as pandas columns, and returns the
    ``added`` columns by name. Other columns pass through as Arrow data, untouched;
    NaN becomes null.

    ``state`` is what all blocks before leave behind, for folds without end:
    ``summary(frame)`` condenses a block to some numbers, and ``combine(state,
    numbers)`` takes the state (None in front) over that block. ``merge(left,
    right)`` makes the numbers of two blocks those of one. One row per block is
    scanned for this, on two levels: ``SCAN_GROUP`` blocks are merged to one row, the
    groups of a key are scanned, and each group is scanned from its own start.
    Without ``summary`` the state is None.
    """
    schema = T.StructType(list(cut.df.schema.fields) + list(added))

    def framed(table: pa.Table) -> pd.DataFrame:
        return table.select([*uses, _POS, _OWN]).to_pandas()

    def run(table: pa.Table, state: list | None = None) -> pa.Table:
        table = ordered_by(table, _POS)
        made = fold(framed(table), state)
        for field in added:
            values = np.asarray(made[field.name])
            missing = np.isnan(values) if values.dtype.kind == "f" else None
            table = table.append_column(field.name, pa.array(values, mask=missing))
        return table.filter(table.column(_OWN))

    groups = [*cut.keys, _BLOCK]
    if summary is None:
        return cut.finish(cut.df.groupBy(*groups).applyInArrow(lambda table: run(table), schema))

    types = {f.name: f.dataType for f in cut.df.schema.fields}
    layout = T.StructType([T.StructField(n, types[n]) for n in groups] + [T.StructField(_STATE, T.ArrayType(T.DoubleType()))])

    def condense(table: pa.Table) -> pa.Table:
        numbers = [float(v) for v in summary(framed(ordered_by(table, _POS)))]
        first = table.slice(0, 1).select(groups)
        return first.append_column(_STATE, pa.array([numbers], pa.list_(pa.float64())))

    narrow = cut.df.select(*groups, *[c for c in uses if c not in groups], _POS, _OWN)
    sums = narrow.groupBy(*groups).applyInArrow(condense, layout)
    carried = _scanned(sums, cut.keys, combine, merge, SCAN_GROUP)

    def resumed(table: pa.Table, states: pa.Table) -> pa.Table:
        return run(table, states.column(_STATE)[0].as_py())

    both = cut.df.groupBy(*groups).cogroup(carried.groupBy(*groups))
    return cut.finish(both.applyInArrow(resumed, schema))


# Ranks below this are limited by Spark in every input partition, before the shuffle.
GROUP_LIMIT = 1000


def _few_last_rows(df: DataFrame, keys: Sequence[str], order: str, n: int, name: str | None) -> DataFrame:
    """Ranks within a key, limited in every input partition first: rows are sent once, ``n`` of a key and partition at most."""
    rank = "__rank"
    in_key = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    kept = df.filter(F.col(order).isNotNull()).withColumn(rank, F.row_number().over(in_key)).filter(F.col(rank) <= n)
    return kept.withColumnRenamed(rank, name) if name else kept.drop(rank)


def last_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    n: int,
    name: str | None = None,
    slicing: Slicing | None = None,
) -> DataFrame:
    """The newest ``n`` rows of each key, for any ``n``; ``name`` keeps the rank (1 = newest).

    A small ``n`` is limited by rank in every input partition. For a larger one rows are counted per slice, slices are summed from the newest, and rows of
    slices behind the one that reaches ``n`` are dropped before anything is
    ranked or shuffled by key. Within the slices that stay, a rank is the row's
    rank in its slice plus the rows of newer slices. Rows without an order value
    are not ranked.
    """
    rank = "__rank"
    if n < GROUP_LIMIT and slicing is None:
        return _few_last_rows(df, keys, order, n, name)
    slicing = slicing or measured(df, order, keys=keys)
    data = _sliced(df, slicing).filter(F.col(order).isNotNull())
    newer = Window.partitionBy(*keys).orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    counts = data.groupBy(*keys, _SLICE).agg(F.count("*").alias("__rows"))
    counts = counts.withColumn("__newer", F.coalesce(F.sum("__rows").over(newer), F.lit(0)))
    needed = counts.filter(F.col("__newer") < n)
    on = [F.col(f"__d.{k}").eqNullSafe(F.col(f"__c.{k}")) for k in [*keys, _SLICE]]
    kept = data.alias("__d").join(needed.alias("__c"), on).select("__d.*", "__c.__newer")
    within = Window.partitionBy(*keys, _SLICE).orderBy(F.desc(order))
    kept = kept.withColumn(rank, (F.col("__newer") + F.row_number().over(within)).cast("int"))
    kept = kept.filter(F.col(rank) <= n).drop(_SLICE, "__newer")
    return kept.withColumnRenamed(rank, name) if name else kept.drop(rank)
