"""Exact per-symbol cleaning and bars on a stream.

One keyed state per symbol holds the last tick the spike filter accepted, the
last tick time, and the open bar. A micro-batch of a symbol is taken in arrival
order with vector operations, so the stream gives what the batch operators give
on the same rows, however they are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.clean import walk_spikes

OUTPUT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("kind", T.StringType()),  # bar, gap, spike, timestamp_reversal
        T.StructField("ts", T.TimestampType()),  # bar open, or the tick's time
        T.StructField("end_ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("tick_count", T.LongType()),
        T.StructField("avg_spread", T.DoubleType()),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("gap_seconds", T.DoubleType()),
    ]
)

_BAR = ("bar_start", "bar_open", "bar_high", "bar_low", "bar_close", "bar_volume", "bar_count", "bar_spread")
_STATE = T.StructType(
    [
        T.StructField("good_ts", T.LongType()),
        T.StructField("good_bid", T.DoubleType()),
        T.StructField("good_ask", T.DoubleType()),
        T.StructField("last_ts", T.LongType()),
        T.StructField("bar_start", T.LongType()),
        T.StructField("bar_open", T.DoubleType()),
        T.StructField("bar_high", T.DoubleType()),
        T.StructField("bar_low", T.DoubleType()),
        T.StructField("bar_close", T.DoubleType()),
        T.StructField("bar_volume", T.DoubleType()),
        T.StructField("bar_count", T.LongType()),
        T.StructField("bar_spread", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class CleanSettings:
    bar_seconds: int = 60
    gap_threshold: float = 30.0
    spike_threshold_percent: float | None = 0.1  # None: no spike filter
    market_gap: float = 300.0


def _at(micros) -> pd.Series:
    return pd.to_datetime(np.asarray(micros, dtype="int64"), unit="us")


def advance(state: dict, frame: pd.DataFrame, s: CleanSettings) -> tuple[dict, list[pd.DataFrame]]:
    """One symbol's ticks in arrival order: the new state and the rows to emit."""
    out: list[pd.DataFrame] = []
    ts = frame["ts"].to_numpy(dtype="datetime64[us]").astype("int64")
    seq = frame["seq"].to_numpy(dtype="int64")
    bid, ask, volume = (frame[c].to_numpy(dtype="float64") for c in ("bid", "ask", "volume"))
    state = dict(state)

    if s.spike_threshold_percent is not None:
        carried = None
        if state.get("good_ts") is not None:
            carried = (state["good_ts"], state["good_bid"], state["good_ask"])
        spike, good = walk_spikes(ts, bid, ask, carried, s.spike_threshold_percent, s.market_gap)
        state["good_ts"], state["good_bid"], state["good_ask"] = good
        if spike.any():
            out.append(pd.DataFrame({"kind": "spike", "ts": _at(ts[spike]), "seq": seq[spike], "close": bid[spike]}))
        keep = ~spike
        ts, seq, bid, ask, volume = ts[keep], seq[keep], bid[keep], ask[keep], volume[keep]
    if len(ts) == 0:
        return state, out

    floor = np.iinfo("int64").min if state.get("last_ts") is None else state["last_ts"]
    before = np.maximum.accumulate(np.concatenate(([floor], ts)))[:-1]
    late = ts < before
    if late.any():
        out.append(
            pd.DataFrame(
                {"kind": "timestamp_reversal", "ts": _at(ts[late]), "seq": seq[late], "close": bid[late], "last_ts": _at(before[late])}
            )
        )
    keep = ~late
    ts, seq, bid, ask, volume, before = ts[keep], seq[keep], bid[keep], ask[keep], volume[keep], before[keep]
    if len(ts) == 0:
        return state, out

    known = before != np.iinfo("int64").min
    gap = np.where(known, (ts - np.where(known, before, ts)) / 1_000_000.0, 0.0)
    hole = gap > s.gap_threshold
    if hole.any():
        out.append(
            pd.DataFrame({"kind": "gap", "ts": _at(ts[hole]), "seq": seq[hole], "last_ts": _at(before[hole]), "gap_seconds": gap[hole]})
        )
    state["last_ts"] = int(ts[-1])

    width = s.bar_seconds * 1_000_000
    bars = (
        pd.DataFrame({"start": ts // width * width, "bid": bid, "volume": volume, "spread": ask - bid})
        .groupby("start", sort=True)
        .agg(
            bar_open=("bid", "first"),
            bar_high=("bid", "max"),
            bar_low=("bid", "min"),
            bar_close=("bid", "last"),
            bar_volume=("volume", "sum"),
            bar_count=("bid", "size"),
            bar_spread=("spread", "sum"),
        )
        .reset_index(names="bar_start")
    )
    if state.get("bar_start") is not None:
        held = {c: state[c] for c in _BAR}
        if held["bar_start"] == bars["bar_start"].iloc[0]:
            first = bars.iloc[0]
            bars.loc[0, "bar_open"] = held["bar_open"]
            bars.loc[0, "bar_high"] = max(held["bar_high"], first["bar_high"])
            bars.loc[0, "bar_low"] = min(held["bar_low"], first["bar_low"])
            for c in ("bar_volume", "bar_count", "bar_spread"):
                bars.loc[0, c] = held[c] + first[c]
        else:
            bars = pd.concat([pd.DataFrame([held]), bars], ignore_index=True)
    done, current = bars.iloc[:-1], bars.iloc[-1]
    for c in _BAR:
        state[c] = int(current[c]) if c in ("bar_start", "bar_count") else float(current[c])
    if len(done):
        out.append(_closed(done, width))
    return state, out


class CleanBars(StatefulProcessor):
    """Spike filter, reversal check, gap check and bars of one symbol."""

    def __init__(self, settings: CleanSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("symbol_state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)
        state = dict(zip(_STATE.fieldNames(), self.held.get())) if self.held.exists() else {}
        out: list[pd.DataFrame] = []
        # A control row "reset" forgets ticks, open bar and last time; settings stay.
        reset = frame["control"].eq("reset").to_numpy() if "control" in frame else np.zeros(len(frame), bool)
        for run, part in frame.groupby(np.cumsum(reset), sort=True):
            if run > 0:
                state = {}
                part = part.iloc[1:]
            if len(part):
                state, made = advance(state, part, self.settings)
                out += made
        if state:
            self.held.update(tuple(state.get(n) for n in _STATE.fieldNames()))
        else:
            self.held.clear()
        # many resets make many small pieces; those of the same columns go as one
        alike: dict[tuple[str, ...], list[pd.DataFrame]] = {}
        for made in out:
            alike.setdefault(tuple(made.columns), []).append(made)
        for some in alike.values():
            yield pd.concat(some, ignore_index=True).assign(symbol=key[0]).reindex(columns=OUTPUT.fieldNames()).pipe(_typed)

    def close(self) -> None:
        pass


class TimedCleanBars(CleanBars):
    """The same, and a bar whose end the watermark has passed closes without its symbol's next tick.

    One event-time timer per symbol stands at the end of its open bar.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timerValues)
        start = self.held.get()[_STATE.fieldNames().index("bar_start")] if self.held.exists() else None
        end = None if start is None else (start + self.settings.bar_seconds * 1_000_000) // 1000
        standing = list(self.handle.listTimers())
        for timer in standing:
            if timer != end:
                self.handle.deleteTimer(timer)
        if end is not None and end not in standing:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = dict(zip(_STATE.fieldNames(), self.held.get())) if self.held.exists() else {}
        if state.get("bar_start") is None:
            return
        width = self.settings.bar_seconds * 1_000_000
        if state["bar_start"] + width <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            bar = pd.DataFrame([{c: state[c] for c in _BAR}])
            yield _closed(bar, width).assign(symbol=key[0]).reindex(columns=OUTPUT.fieldNames()).pipe(_typed)
            self.held.update(tuple(None if n in _BAR else state[n] for n in _STATE.fieldNames()))


class RecentTicks(StatefulProcessor):
    """The last ``n`` ticks of a symbol in a list that never holds more."""

    def __init__(self, n: int, schema: T.StructType):
        self.n, self.schema = n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, at = self.schema.fieldNames(), self.schema.fieldNames().index("seq")
        held = list(self.ring.get()) if self.ring.exists() else []
        parts, count = [], 0
        for frame in rows:
            parts.append(frame[names])
            count += len(frame)
            if count > 16 * self.n + 65_536:
                parts = [pd.concat(parts).nlargest(self.n, "seq")]
                count = len(parts[0])
        few = pd.concat(parts).nlargest(self.n, "seq")
        for c in names:
            if isinstance(self.schema[c].dataType, T.TimestampType):
                few[c] = few[c].dt.to_pydatetime()
        held = sorted([*held, *few.itertuples(index=False, name=None)], key=lambda r: r[at])[-self.n :]
        self.ring.put([tuple(r) for r in held])
        yield pd.DataFrame({"symbol": [key[0]], "held": [len(held)]})

    def close(self) -> None:
        pass


def keep_recent(stream: DataFrame, n: int = 10_000) -> DataFrame:
    """Keep the last ``n`` ticks of each symbol as the stream's state; a row per symbol and batch says how many there are.

    Needs the RocksDB state store provider. ``recent_of`` reads the ticks back.
    """
    schema = T.StructType([f for f in stream.schema.fields if f.name != "symbol"])
    return stream.groupBy("symbol").transformWithStateInPandas(
        RecentTicks(n, schema), outputStructType="symbol string, held long", outputMode="Update", timeMode="None"
    )


def recent_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The ticks that the last finished batch of a ``keep_recent`` query left in its state."""
    state = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return state.select("key.symbol", "list_element.*")


def _closed(bars: pd.DataFrame, width: int) -> pd.DataFrame:
    """Output rows of finished bars of the state's layout."""
    start = bars["bar_start"].to_numpy(dtype="int64")
    return pd.DataFrame(
        {
            "kind": "bar",
            "ts": _at(start),
            "end_ts": _at(start + width - 1),
            "open": bars["bar_open"].to_numpy(),
            "high": bars["bar_high"].to_numpy(),
            "low": bars["bar_low"].to_numpy(),
            "close": bars["bar_close"].to_numpy(),
            "volume": bars["bar_volume"].to_numpy(),
            "tick_count": bars["bar_count"].to_numpy(dtype="int64"),
            "avg_spread": (bars["bar_spread"] / bars["bar_count"]).to_numpy(),
        }
    )


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    for field in OUTPUT.fields:
        if isinstance(field.dataType, T.TimestampType):
            frame[field.name] = pd.to_datetime(frame[field.name]).astype("datetime64[us]")
        elif isinstance(field.dataType, T.LongType):
            frame[field.name] = frame[field.name].astype("Int64")
        elif isinstance(field.dataType, T.DoubleType):
            frame[field.name] = frame[field.name].astype("float64")
    return frame


def clean_bars(stream: DataFrame, settings: CleanSettings = CleanSettings(), *, close_after: str | None = None) -> DataFrame:
    """Bars, gaps, spikes and reversals of a tick stream, told apart by ``kind``.

    A bar closes when a later tick of its symbol comes. With ``close_after`` it also
    closes when the watermark, that far behind the newest tick of any symbol, passes its
    end; ticks behind the watermark are then dropped (``sinks.dropped_rows`` counts
    them). Needs the RocksDB state store provider.
    """
    if close_after is not None:
        return stream.withWatermark("ts", close_after).groupBy("symbol").transformWithStateInPandas(
            TimedCleanBars(settings), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    return stream.groupBy("symbol").transformWithStateInPandas(
        CleanBars(settings), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def only_bars(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("kind") == "bar").select(
        "symbol",
        F.col("ts").alias("time"),
        F.col("end_ts").alias("end_time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "tick_count",
        "avg_spread",
    )


def only_gaps(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("kind") == "gap").select("symbol", "last_ts", "ts", "gap_seconds")


def late_rows(cleaned: DataFrame) -> DataFrame:
    """Ticks that ran back in time, with their reason."""
    return cleaned.filter(F.col("kind") == "timestamp_reversal").select(
        "symbol", "ts", "last_ts", "seq", F.col("kind").alias("reason")
    )
