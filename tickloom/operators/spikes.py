"""Percent spike filter: a tick is compared with the last *accepted* one.

A decision depends on all decisions before it, but walks that accept one common tick coincide from there on. So a run of
ticks is condensed to a transfer map: from the tick carried in to the tick handed over. What can be handed over are few
ticks, the *ends* of the run: those that accept no later tick of it, which therefore lie within its last ``market_gap``
seconds. The history is cut into slices, and one row per slice
(its first ticks and where walks that accept them end, its ends, its price range) settles nearly all of them without a second
look: a carried tick that accepts one of the first ticks ends like the walk from there, and one that is out of the slice's
range passes through it.

For the others the map is made from the ticks themselves: for the tick really carried in, and, over the next thousands of
slices and eight times as many each time, for all ends of the slice before. So few rounds read ticks, also where two price
levels never agree. Slices may be light: those that lie behind each other in a task are looked at together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import Slicing, equal_depth
from tickloom.session import written

Tick = tuple[int, float, float]  # time in µs, bid, ask

_TICK = T.StructType([T.StructField("ts", T.LongType()), T.StructField("bid", T.DoubleType()), T.StructField("ask", T.DoubleType())])
_ARROW_TICK = pa.struct([("ts", pa.int64()), ("bid", pa.float64()), ("ask", pa.float64())])
_ARROW_MOVE = pa.struct([("before", _ARROW_TICK), ("after", _ARROW_TICK)])
_MOVE = T.StructType([T.StructField("before", _TICK), T.StructField("after", _TICK)])
_HEADS = T.StructType(
    [
        T.StructField("ts", T.ArrayType(T.LongType())),
        T.StructField("bid", T.ArrayType(T.DoubleType())),
        T.StructField("ask", T.ArrayType(T.DoubleType())),
        T.StructField("end", T.ArrayType(T.LongType())),
        T.StructField("whole", T.BooleanType()),
    ]
)
_RANGE = ("ts_high", "bid_low", "bid_high", "ask_low", "ask_high")


def usable_quotes(bid, ask):
    """Rows whose bid and ask are positive finite numbers."""
    with np.errstate(invalid="ignore"):
        return (bid > 0) & (ask > 0) & np.isfinite(bid) & np.isfinite(ask)


def _moved(b0, a0, bid, ask):
    """Percent by which bid or ask have moved, the larger one."""
    return np.maximum(np.abs((bid - b0) / b0) * 100, np.abs((ask - a0) / a0) * 100)


# Ticks behind a stretch that are looked at for all stretches together; a later one is searched for when it is needed.
LOOK = 32
_NONE, _UNKNOWN = -1, -2


class Run:
    """Usable ticks in arrival order; stretches where each tick accepts the next are walked in one step.

    ``stops`` cuts them into several runs, each walked on its own and named by its number.
    """

    def __init__(
        self, ts: np.ndarray, bid: np.ndarray, ask: np.ndarray, threshold: float, market_gap: float, stops: np.ndarray | None = None
    ) -> None:
        self.ts, self.bid, self.ask = ts, bid, ask
        self.threshold, self.gap = threshold, int(market_gap * 1_000_000)
        self.stops = np.array([len(ts)]) if stops is None else stops
        self.starts = np.append(0, self.stops[:-1])
        breaks = np.ones(len(ts), bool)
        if len(ts):
            breaks[:-1] = ~self.accepts(np.arange(len(ts) - 1), np.arange(1, len(ts)))
            breaks[self.stops[self.stops > self.starts] - 1] = True
        self.last = np.flatnonzero(breaks)
        self.first_stretch, self.stop_stretch = np.searchsorted(self.last, self.starts), np.searchsorted(self.last, self.stops)
        self.limit = np.repeat(self.stops, self.stop_stretch - self.first_stretch)  # where the run of a stretch ends
        self.known = self._hops()
        to = np.where(self.known < 0, self.known, np.searchsorted(self.last, self.known))
        # the tick that the last one of a stretch accepts next, its stretch, and the stretch where the walk ends
        self.hop, self.to, self.final = self.known.tolist(), to.tolist(), [_UNKNOWN] * len(self.last)
        self.last_of = self.last.tolist()

    def accepts(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        far = self.ts[j] - self.ts[i] > self.gap
        return far | ~(_moved(self.bid[i], self.ask[i], self.bid[j], self.ask[j]) > self.threshold)

    def _hops(self) -> np.ndarray:
        hop, left = np.full(len(self.last), _UNKNOWN), np.arange(len(self.last))
        for step in range(2, LOOK + 2):  # the next tick is out of the stretch because it is not accepted
            at = self.last[left] + step
            inside = at < self.limit[left]
            hop[left[~inside]] = _NONE
            left, at = left[inside], at[inside]
            if not len(left):
                break
            good = self.accepts(self.last[left], at)
            hop[left[good]] = at[good]
            left = left[~good]
        return hop

    def tick(self, i: int) -> Tick:
        return int(self.ts[i]), float(self.bid[i]), float(self.ask[i])

    def accepted(self, state: Tick, start: int, stop: int | None = None) -> int | None:
        """The first tick from ``start`` on that ``state`` accepts."""
        t0, b0, a0 = state
        stop, step = len(self.ts) if stop is None else stop, 32
        while start < stop:
            part = slice(start, min(start + step, stop))
            good = (self.ts[part] - t0 > self.gap) | ~(_moved(b0, a0, self.bid[part], self.ask[part]) > self.threshold)
            if good.any():
                return start + int(good.argmax())
            start, step = start + step, step * 2
        return None

    def next_stretch(self, s: int) -> int:
        """The stretch that the last tick of stretch ``s`` goes on with."""
        if self.to[s] == _UNKNOWN:
            at = self.last_of[s]
            found = self.accepted(self.tick(at), at + LOOK + 2, int(self.limit[s]))
            self.hop[s] = _NONE if found is None else found
            self.to[s] = _NONE if found is None else self.stretch(found)
        return self.to[s]

    def stretch(self, i: int) -> int:
        return int(np.searchsorted(self.last, i))

    def end_of(self, s: int) -> int:
        """The last tick that a walk accepts which accepts a tick of stretch ``s``."""
        path = []
        while self.final[s] < 0:
            path.append(s)
            to = self.next_stretch(s)
            if to == _NONE:
                self.final[s] = s
                break
            s = to
        end = self.final[s]
        for p in path:
            self.final[p] = end
        return self.last_of[end]

    def first_accepted(self, carried: Tick | None, k: int) -> int | None:
        start, stop = int(self.starts[k]), int(self.stops[k])
        return (start if start < stop else None) if carried is None else self.accepted(carried, start, stop)

    def transfer(self, carried: Tick | None, k: int = 0) -> Tick | None:
        """What is handed over when ``carried`` comes into run ``k``."""
        first = self.first_accepted(carried, k)
        return carried if first is None else self.tick(self.end_of(self.stretch(first)))

    def transfer_behind(self, i: int, start: int, k: int) -> int:
        """The tick that is handed over when tick ``i`` is carried to ``start`` in run ``k``."""
        first = self.accepted(self.tick(i), start, int(self.stops[k]))
        return i if first is None else self.end_of(self.stretch(first))

    def end_ticks(self, k: int) -> list[int]:
        """Ticks that accept no later one: all that a walk of run ``k`` can hand over but what it was given."""
        a, b = int(self.first_stretch[k]), int(self.stop_stretch[k])
        open_ = a + np.flatnonzero(self.known[a:b] < 0)
        if (self.known[open_] == _UNKNOWN).any():
            start, stop = self.starts[k], self.stops[k]
            later = np.maximum.accumulate(self.ts[start:stop][::-1])[::-1]
            behind = np.minimum(self.last[open_] + 1, stop - 1) - start
            open_ = open_[(self.known[open_] == _NONE) | (later[behind] - self.ts[self.last[open_]] <= self.gap)]
        return [self.last_of[s] for s in open_.tolist() if self.next_stretch(s) == _NONE]

    def ends(self, k: int = 0) -> list[Tick]:
        return [self.tick(i) for i in self.end_ticks(k)]

    def flags(self, carried: Tick | None, k: int = 0) -> np.ndarray:
        start = int(self.starts[k])
        edge = np.zeros(int(self.stops[k]) - start + 1, np.int8)
        i = self.first_accepted(carried, k)
        if i is not None:
            begins, behind, s = [], [], self.stretch(i)
            while True:
                begins.append(i)
                behind.append(self.last_of[s] + 1)
                to = self.next_stretch(s)
                if to == _NONE:
                    break
                i, s = self.hop[s], to
            edge[np.array(begins) - start] = 1
            edge[np.array(behind) - start] = -1
        return np.cumsum(edge[:-1], dtype=np.int8) == 0


def walk_spikes(ts, bid, ask, carried: Tick | None, threshold: float, market_gap: float):
    """Decide each tick of one run; returns (spike flags, last accepted tick).

    ``carried`` is the tick accepted before the run, or None. Ticks without two positive finite quotes are flagged and
    never accepted.
    """
    usable = usable_quotes(bid, ask)
    flags = ~usable
    run = Run(ts[usable], bid[usable], ask[usable], threshold, market_gap)
    flags[usable] = run.flags(carried)
    good = np.flatnonzero(~flags)
    return flags, (int(ts[good[-1]]), float(bid[good[-1]]), float(ask[good[-1]])) if len(good) else carried


class SliceRow:
    """What is known of a slice without its ticks."""

    def __init__(self, row: dict, moves: Iterable[dict], threshold: float, market_gap: float) -> None:
        self.row, self.threshold, self.gap = row, threshold, int(market_gap * 1_000_000)
        tick = lambda t: t and (t["ts"], t["bid"], t["ask"])
        self.first, self.free = tick(row["first"]), tick(row["free"])
        self.ends = [tick(t) for t in row["ends"]]
        self.heads = row.get("heads")  # the ticks behind the first one: times, bids, asks, places of their ends among the ends
        self.moves = {tick(m["before"]): tick(m["after"]) for m in moves}

    def transfer(self, carried: Tick | None) -> tuple[bool, Tick | None]:
        """Whether it is known what ``carried`` becomes, and what."""
        if self.first is None:  # no usable tick
            return True, carried
        if carried is None:
            return True, self.free
        (t0, b0, a0), (t, b, a) = carried, self.first
        if t - t0 > self.gap or not _moved(b0, a0, b, a) > self.threshold:
            return True, self.free
        if self.heads:
            good = (self.heads["ts"] - t0 > self.gap) | ~(_moved(b0, a0, self.heads["bid"], self.heads["ask"]) > self.threshold)
            if good.any():
                return True, self.ends[self.heads["end"][int(good.argmax())]]
            if self.heads["whole"]:
                return True, carried
        if self.row["ts_high"] - t0 <= self.gap and any(self._outside(q, x) for q, x in (("bid", b0), ("ask", a0))):
            return True, carried
        return carried in self.moves, self.moves.get(carried)

    def _outside(self, quote: str, x: float) -> bool:
        low, high = self.row[f"{quote}_low"], self.row[f"{quote}_high"]
        nearest = low if low > x else high if high < x else x
        return abs((nearest - x) / x) * 100 > self.threshold


def scan(rows: list[SliceRow], reach: int) -> tuple[list[Tick | None], dict[int, list[Tick]]]:
    """The tick carried into each slice of one symbol, as far as it is known, and what to ask of which slices next.

    From the first slice whose map lacks the carried tick on, ``reach`` slices are asked for all that may come in.
    """
    carried: list[Tick | None] = []
    state: Tick | None = None
    for k, row in enumerate(rows):
        carried.append(state)
        known, after = row.transfer(state)
        if known:
            state = after
            continue
        asked, before = {}, [state, *(rows[k - 1].ends if k else [])]
        for j in range(k, min(k + reach, len(rows))):
            # the carried tick may pass several slices
            missing = [t for t in dict.fromkeys([state, *before]) if not rows[j].transfer(t)[0]]
            if missing:
                asked[j] = missing
            before = rows[j].ends or before
        return carried, asked
    return carried, {}


def _quotes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times (µs), bids and asks of the rows; a row without a time has no usable bid."""
    ts = table.column("ts").cast(pa.timestamp("us")).cast(pa.int64())
    bid = np.where(ts.is_valid().to_numpy(), table.column("bid").to_numpy(), np.nan)
    return ts.fill_null(0).to_numpy(), bid, table.column("ask").to_numpy()


# Rows that are looked at together, where groups are small.
CHUNK_ROWS = 1 << 15


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where the groups of a sorted table begin; nulls are a group."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for key in keys:
        column = table.column(key)
        a, b = column.slice(0, table.num_rows - 1), column.slice(1)
        other = pa.compute.fill_null(pa.compute.not_equal(a, b), False).to_numpy()
        new[1:] |= other | (a.is_null().to_numpy() != b.is_null().to_numpy())
    return np.flatnonzero(new)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Sorted rows as tables of whole groups, with the bounds of the groups."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, CHUNK_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, keys)
            last = int(starts[-1])  # the last group may go on
            if last:
                yield table.slice(0, last), list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            held, rows = table.slice(last).to_batches(), table.num_rows - last
            enough = max(CHUNK_ROWS, 2 * rows)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        yield table, list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True))


def _by_group(
    df: DataFrame, keys: Sequence[str], order: Sequence, work: Callable, layout: T.StructType, together: Sequence | None = None
) -> DataFrame:
    """``work(table, bounds)`` over many whole groups at a time, sorted: a group alone is too small a unit where keys are light.

    Groups that agree in ``together`` come to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _whole_groups(batches, keys):
            yield from work(table, bounds).to_batches()

    return df.repartition(*(together or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, layout)


def _ticks(run: Run, at: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(run.ts[at], pa.int64()), pa.array(run.bid[at]), pa.array(run.ask[at])], fields=list(_ARROW_TICK))


def _spread(values: pa.Array, at: np.ndarray, rows: int) -> pa.Array:
    """``values`` in the rows ``at`` of so many, nulls in the others."""
    place, missing = np.zeros(rows, np.int64), np.ones(rows, bool)
    place[at], missing[at] = np.arange(len(at)), False
    return values.take(pa.array(place, mask=missing))


def _heads(column: pa.ChunkedArray) -> list[dict]:
    """The entries of a column of heads; their numbers stay arrays."""
    *lists, whole = column.combine_chunks().flatten()
    parts = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in lists]
    return [
        {"whole": all_} | {f.name: values[at[i] : at[i + 1]] for f, (at, values) in zip(_HEADS, parts, strict=False)}
        for i, all_ in enumerate(whole.to_pylist())
    ]


def _shown(tick: Tick | None) -> dict | None:
    return tick and dict(zip(("ts", "bid", "ask"), tick, strict=True))


def _same_slice(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose symbol and slice are in ``right``; rows without a symbol or number form slices too."""
    other = right.select(F.col("symbol").alias("__symbol"), F.col("__slice").alias("__other"))
    same = F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("__slice").eqNullSafe(F.col("__other"))
    return left.join(other, same, "left_semi")


@dataclass(frozen=True)
class _Rule:
    threshold: float
    market_gap: float

    def runs(self, table: pa.Table, bounds: list[tuple[int, int]], own: np.ndarray | None = None) -> tuple[Run, np.ndarray]:
        """The groups of the table as runs, and which of its rows are in them: usable ticks, and ``own`` if given."""
        ts, bid, ask = _quotes(table)
        usable = usable_quotes(bid, ask)
        usable = usable if own is None else usable & own
        stops = np.append(0, np.cumsum(usable))[[b for _, b in bounds]]
        return Run(ts[usable], bid[usable], ask[usable], self.threshold, self.market_gap, stops), usable

    def row(self, row: dict, moves: Iterable[dict]) -> SliceRow:
        return SliceRow(row, moves, self.threshold, self.market_gap)


# Slices that the first round may ask, which reads the table once however many; each further one eight times as many.
FIRST_REACH = 4096
# Ticks of a slice, behind its first one, that its row knows the ends of. Up to so many more where the slice before was in
# another task, if that is a small part of the ticks: of the slice itself, or of those looked at together.
HEADS, EDGE_HEADS = 16, 1024
# Ticks that passed whole slices and are followed on, at most; the rounds ask for others.
PASSING = 64


class _Filter:
    """The jobs of one filter over ``symbol, __slice, ts, seq, bid, ask`` rows."""

    def __init__(self, runs: DataFrame, threshold: float, market_gap: float, together: int = 1) -> None:
        """``together``: how many neighbouring slices a task may look at at a time."""
        self.runs, self.rule, self.together = runs, _Rule(threshold, market_gap), together
        self.key = [runs.schema["symbol"], T.StructField("__slice", T.LongType())]

    def summaries(self) -> DataFrame:
        """One row per slice."""
        ranges = [T.StructField(c, T.LongType() if c == "ts_high" else T.DoubleType()) for c in _RANGE]
        layout = T.StructType(
            [
                *self.key,
                *[T.StructField(c, _TICK) for c in ("first", "free")],
                T.StructField("ends", T.ArrayType(_TICK)),
                T.StructField("heads", _HEADS),
                T.StructField("within", T.ArrayType(_MOVE)),
                *ranges,
            ]
        )

        rule, together, heads_of, most = self.rule, self.together, HEADS, EDGE_HEADS

        def within(run: Run, edge: np.ndarray, counts: np.ndarray, ends: list[list[int]]) -> list[list[dict]]:
            """What the heads do not tell of the ticks that the slices before in this task hand over."""
            moves, coming = [], np.zeros(0, np.int64)
            for k in range(len(edge)):
                known, passing, start = [], coming[:0], run.starts[k]
                if len(coming) and not edge[k]:
                    told = start + np.arange(min(counts[k] + 1, run.stops[k] - start))
                    passing = coming[~run.accepts(coming[:, None], told[None, :]).any(axis=1)]
                    if start + len(told) < run.stops[k]:
                        after = [run.transfer_behind(i, int(start) + len(told), k) for i in passing.tolist()]
                        known = [{"before": _shown(run.tick(i)), "after": _shown(run.tick(j))} for i, j in zip(passing.tolist(), after, strict=True)]
                        passing = passing[np.array(after, np.int64) == passing]
                moves.append(known)
                coming = np.append(np.array(ends[k], np.int64), passing[:PASSING])
            return moves

        def summarise(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
            run, _ = rule.runs(table, bounds)
            sizes = run.stops - run.starts
            some = np.flatnonzero(sizes)
            ends = [run.end_ticks(k) for k in range(len(bounds))]
            firsts = run.starts[some]
            frees = [run.end_of(s) for s in run.first_stretch[some].tolist()]
            # the first ticks of all slices, slice after slice
            names = table.select(["symbol", "__slice"]).take([a for a, _ in bounds])
            names = names.append_column("group", pa.compute.divide(names.column("__slice"), together))
            edge = np.isin(np.arange(len(bounds)), _starts(names, ["symbol", "group"]))
            more = np.minimum(np.maximum(sizes // 32, together * heads_of), most)
            counts = np.minimum(np.maximum(sizes - 1, 0), np.where(edge, more, heads_of))
            heads = np.repeat(run.starts + 1 - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            last_ticks = np.array([run.end_of(s) for s in np.searchsorted(run.last, heads).tolist()], np.int64)
            flat = np.array([i for found in ends for i in found], np.int64)
            before = np.append(0, np.cumsum([len(found) for found in ends]))
            place = np.searchsorted(flat, last_ticks) - np.repeat(before[:-1], counts)

            def lists(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

            upto = np.append(0, np.cumsum(counts))
            columns = [lists(run.ts[heads], upto), lists(run.bid[heads], upto), lists(run.ask[heads], upto), lists(place, upto), pa.array(counts == sizes - 1)]
            out = names.select(["symbol", "__slice"])
            out = out.append_column("first", _spread(_ticks(run, firsts), some, len(bounds)))
            out = out.append_column("free", _spread(_ticks(run, np.array(frees, np.int64)), some, len(bounds)))
            out = out.append_column("ends", lists(_ticks(run, flat), before))
            out = out.append_column("heads", pa.StructArray.from_arrays(columns, [f.name for f in _HEADS]))
            out = out.append_column("within", pa.array(within(run, edge, counts, ends), pa.list_(_ARROW_MOVE)))
            for name in _RANGE:
                column = {"ts": run.ts, "bid": run.bid, "ask": run.ask}[name.split("_")[0]]
                fold = np.minimum if name.endswith("low") else np.maximum
                values = fold.reduceat(column, firsts) if len(some) else column
                out = out.append_column(name, _spread(pa.array(values), some, len(bounds)))
            return out

        near = [F.col("symbol"), F.floor(F.col("__slice") / together)]
        return _by_group(self.runs, ["symbol", "__slice"], ["seq"], summarise, layout, near)

    def scanned(self, summaries: DataFrame, maps: DataFrame, reach: int) -> DataFrame:
        """``symbol, __slice, carried, asked``; one row per slice is looked at."""
        layout = T.StructType([*self.key, T.StructField("carried", _TICK), T.StructField("asked", T.ArrayType(_TICK))])

        rule = self.rule

        def one(table: pa.Table) -> tuple[list, list]:
            rows = table.drop_columns("heads").to_pylist()
            for r, heads in zip(rows, _heads(table.column("heads")), strict=True):
                r["heads"] = heads
            moves: dict[int | None, list[dict]] = {}
            for r in rows:
                moves.setdefault(r["__slice"], []).extend(r["within"] if r["moves"] is None else r["moves"])
            # slices come in order; ticks without a number are a run of their own, in front of nothing
            inner = [k for k, r in enumerate(rows) if r["moves"] is None and r["__slice"] is not None]
            found, asked = scan([rule.row(rows[k], moves.get(rows[k]["__slice"], ())) for k in inner], reach)
            carried, wanted = [None] * len(rows), [None] * len(rows)
            for k, tick in zip(inner, found, strict=False):
                carried[k] = _shown(tick)
            for at, ticks in asked.items():
                wanted[inner[at]] = [_shown(t) for t in ticks]
            return carried, wanted

        def run(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
            made = [one(table.slice(a, b - a)) for a, b in bounds]
            out = table.select(["symbol", "__slice"])
            out = out.append_column("carried", pa.array([t for carried, _ in made for t in carried], _ARROW_TICK))
            out = out.append_column("asked", pa.array([t for _, wanted in made for t in wanted], pa.list_(_ARROW_TICK)))
            return out.filter(table.column("moves").is_null())

        both = summaries.unionByName(maps, allowMissingColumns=True)
        return _by_group(both, ["symbol"], ["__slice"], run, layout)

    def answered(self, asked: DataFrame) -> DataFrame:
        """``symbol, __slice, moves``: the asked entries of the slices' maps, from their ticks."""
        layout = T.StructType([*self.key, T.StructField("moves", T.ArrayType(_MOVE))])

        rule = self.rule

        def answer(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
            questions = table.column("asked").take([a for a, _ in bounds]).to_pylist()
            moves = []
            run, _ = rule.runs(table, bounds)
            # the question is the first row of a slice
            for k, question in enumerate(questions):
                states = [t and (t["ts"], t["bid"], t["ask"]) for t in question]
                moves.append([{"before": _shown(s), "after": _shown(run.transfer(s, k))} for s in states])
            out = table.select(["symbol", "__slice"]).take([a for a, _ in bounds])
            return out.append_column("moves", pa.array(moves, pa.list_(_ARROW_MOVE)))

        some = _same_slice(self.runs, asked).unionByName(asked, allowMissingColumns=True)
        return _by_group(some, ["symbol", "__slice"], [F.col("asked").isNull(), "seq"], answer, layout)

    def carried(self, several: DataFrame | None = None) -> tuple[DataFrame | None, int]:
        """The tick carried into each slice and how often ticks were read for it; None where no symbol has two slices.

        ``several`` has the symbols that may have two, if they are known.
        """
        if several is None:
            found = self.runs.groupBy("symbol").agg((F.min("__slice") < F.max("__slice")).alias("several")).filter("several")
            several = written(found.select("symbol"), "spike-symbols")
            if several.isEmpty():
                return None, 0
        several = several.select(F.col("symbol").alias("__symbol"))
        self.runs = self.runs.join(several, F.col("symbol").eqNullSafe(F.col("__symbol")), "left_semi")
        summaries = written(self.summaries(), "spike-slices")
        maps = summaries.sparkSession.createDataFrame([], T.StructType([*self.key, T.StructField("moves", T.ArrayType(_MOVE))]))
        rounds = 0
        while True:
            state = written(self.scanned(summaries, maps, FIRST_REACH << (3 * rounds)), "spike-scan")
            asked = state.filter("asked is not null").select("symbol", "__slice", "asked")
            if asked.isEmpty():
                return state.select("symbol", "__slice", "carried"), rounds
            maps = maps.unionAll(written(self.answered(asked), "spike-maps"))
            rounds += 1


def flag_spikes(
    ticks: DataFrame,
    threshold_percent: float = 0.1,
    market_gap: float = 300.0,
    slicing: Slicing | None = None,
) -> DataFrame:
    """Add ``is_spike``: bid or ask moved more than ``threshold_percent`` from the last
    accepted tick. The first tick and ticks more than ``market_gap`` seconds after the
    last accepted one are accepted. Ticks without two positive finite quotes are
    flagged and compared with nothing. Rows without a symbol or an arrival number
    stay: each such group is walked on its own.

    Slices are of equal depth unless given: one counter may serve many light symbols,
    whose ticks would lie one by one in slices of fixed width.

    This runs Spark jobs while it is called (one that counts the ticks of a symbol, and
    where a symbol needs several slices, one that returns a row per slice and one per
    round for slices in doubt); the flags themselves are lazy.
    """
    if threshold_percent <= 0 or market_gap < 0:
        raise ValueError("threshold_percent must be positive and market_gap non-negative")
    slicing = slicing or equal_depth(ticks)
    typed = ticks.withColumns({"bid": F.col("bid").cast("double"), "ask": F.col("ask").cast("double")})
    runs, carried = slicing.cut(typed), None
    if not slicing.single:
        narrow = runs.select("symbol", "__slice", "ts", "seq", "bid", "ask")
        several = slicing.cut_keys
        known = several is not None and several.columns == ["symbol"]
        # a slice has ``width`` rows at most, or about so many
        together = 1 if slicing.is_time else max(1, CHUNK_ROWS // slicing.width)
        carried, _ = _Filter(narrow, threshold_percent, market_gap, together).carried(several if known else None)
    schema = T.StructType([*typed.schema.fields, T.StructField("is_spike", T.BooleanType())])
    names = typed.columns

    rule = _Rule(threshold_percent, market_gap)

    def decide(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        own = table.column("__edge").to_numpy() == 0
        run, usable = rule.runs(table, bounds, own)
        # the tick carried into a slice is its first row
        states = table.column("__carried").take([a for a, _ in bounds]).to_pylist()
        spikes = np.ones(table.num_rows, bool)
        found = [run.flags(state and (state["ts"], state["bid"], state["ask"]), k) for k, state in enumerate(states)]
        spikes[usable] = np.concatenate(found)
        return table.select(names).append_column("is_spike", pa.array(spikes)).filter(pa.array(own))

    rows = runs.withColumns({"__carried": F.lit(None).cast(_TICK), "__edge": F.lit(0)})
    if carried is not None:
        edges = carried.select("symbol", "__slice", F.col("carried").alias("__carried"), F.lit(-1).alias("__edge"))
        rows = rows.unionByName(edges, allowMissingColumns=True)
    return _by_group(rows, ["symbol", "__slice"], ["__edge", "seq"], decide, schema)


def drop_spikes(ticks: DataFrame, **options) -> DataFrame:
    return flag_spikes(ticks, **options).filter(~F.col("is_spike")).drop("is_spike")
