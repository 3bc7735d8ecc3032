"""Indicators over bars: definitions, functions on frames, and a dispatcher by name.

Moving averages and bands are plain window frames inside blocks. Recursive
averages (EMA, MACD, Wilder RSI) and rank correlation run in pandas over one
block at a time. A recursive average is an affine map of what came before it:
every block is condensed to a few numbers, a scan over one row per block gives
each block the exact state it starts from, and nothing is cut off.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import (
    DEFAULT_BLOCK_ROWS,
    Blocks,
    Slicing,
    blocks,
    by_time,
    fold_blocks,
    last_rows,
)

# Configured periods.
EMA_PERIODS = (5, 20, 50, 100, 200)
RCI_PERIODS = (9, 13, 24, 33, 48, 66, 108)
MA_PERIODS = (5, 20, 50)

DEFAULT_SLICING = by_time(45 * 86_400)


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


@dataclass(frozen=True)
class Indicator:
    """What an indicator needs and adds: window columns, or values per block in pandas."""

    lookback: int
    columns: Callable[[Blocks], dict[str, Column]] | None = None
    fold: Callable[[pd.DataFrame, list[float] | None], dict[str, object]] | None = None
    uses: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()
    # For folds that never forget: a block in ``size`` numbers, and the state behind it.
    summary: Callable[[pd.DataFrame], list[float]] | None = None
    combine: Callable[[list[float] | None, list[float]], list[float]] | None = None
    size: int = 0
    # The numbers of two blocks, one behind the other, as those of one block.
    merge: Callable[[list[float], list[float]], list[float]] | None = None


def add_indicators(
    bars: DataFrame,
    indicators: Sequence[Indicator],
    keys: Sequence[str] = ("symbol",),
    slicing: Slicing = DEFAULT_SLICING,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Add all indicators in one pass: rows are numbered once and cut into blocks once.

    Window frames and pandas folds work on the same blocks, so both share one
    shuffle and one sort order.
    """
    cut = blocks(bars, keys, slicing, max(i.lookback for i in indicators), block_rows)
    made: dict[str, Column] = {}
    for i in indicators:
        if i.columns:
            made |= i.columns(cut)
    if made:
        cut = replace(cut, df=cut.df.select("*", *[c.alias(n) for n, c in made.items()]))
    folds = [i for i in indicators if i.fold]
    if not folds:
        return cut.finish(cut.df)

    endless = [i for i in folds if i.summary]
    cuts = np.cumsum([0, *[i.size for i in endless]])

    def parts(numbers: list[float] | None) -> list[list[float] | None]:
        return [numbers and numbers[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def fold(frame: pd.DataFrame, state: list[float] | None) -> dict[str, object]:
        added: dict[str, object] = {}
        states = iter(parts(state))
        for i in folds:
            added |= i.fold(frame, next(states) if i.summary else None)
        return added

    def summary(frame: pd.DataFrame) -> list[float]:
        return [v for i in endless for v in i.summary(frame)]

    def combine(state: list[float] | None, numbers: list[float]) -> list[float]:
        joined = zip(endless, parts(state), parts(numbers), strict=True)
        return [v for i, before, block in joined for v in i.combine(before, block)]

    def merge(left: list[float], right: list[float]) -> list[float]:
        joined = zip(endless, parts(left), parts(right), strict=True)
        return [v for i, a, b in joined for v in i.merge(a, b)]

    uses = sorted({c for i in folds for c in i.uses})
    added = [_double(n) for i in folds for n in i.adds]
    return fold_blocks(cut, fold, uses, added, *((summary, combine, merge) if endless else ()))


def _periods(period: int | Sequence[int]) -> list[int]:
    return [period] if isinstance(period, int) else list(period)


def _own(frame: pd.DataFrame, column: str) -> np.ndarray:
    """Values of the block's own rows."""
    return frame[column].to_numpy("float64", na_value=np.nan)[frame["__own"].to_numpy()]


def _padded(frame: pd.DataFrame, values: np.ndarray) -> np.ndarray:
    """Values of own rows, with the halo rows in front empty."""
    return np.concatenate([np.full(len(frame) - len(values), np.nan), values])


def _ema(x: np.ndarray, alpha: float, start: float = np.nan) -> np.ndarray:
    """Exponential average from ``start`` on, or from the first value where that is missing.

    Missing values leave the average as it was.
    """
    held = ~np.isnan(x)
    values = np.concatenate([[start], x[held]])
    if np.isnan(start):
        values = values[1:]
    smooth = pd.Series(values).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    smooth = smooth if np.isnan(start) else smooth[1:]
    at = np.cumsum(held) - 1
    out = np.full(len(x), start)
    out[at >= 0] = smooth[at[at >= 0]]
    return out


def _last(x: np.ndarray) -> float:
    return float(x[-1]) if len(x) else np.nan


# Definitions. Each takes its own parameters and ignores none.


def sma_of(period: int | Sequence[int] = 20, column: str = "close", name: str = "SMA_{}") -> Indicator:
    periods = _periods(period)

    def columns(cut: Blocks) -> dict[str, Column]:
        return {name.format(n): cut.full(n, F.avg(column).over(cut.frame(n))) for n in periods}

    return Indicator(max(periods) - 1, columns)


def moving_averages_of(period: int | Sequence[int] = MA_PERIODS, column: str = "close") -> Indicator:
    return sma_of(period, column, "MA{}")


def bollinger_of(period: int = 20, width: float = 2.0, column: str = "close") -> Indicator:
    def columns(cut: Blocks) -> dict[str, Column]:
        frame = cut.frame(period)
        middle = cut.full(period, F.avg(column).over(frame))
        std = cut.full(period, F.stddev_samp(column).over(frame))
        return {
            "bb_middle": middle,
            "bb_std": std,
            "bb_upper": middle + width * std,
            "bb_lower": middle - width * std,
        }

    return Indicator(period - 1, columns)


def ema_of(period: int | Sequence[int] = EMA_PERIODS, column: str = "close") -> Indicator:
    periods = _periods(period)
    alphas = [2 / (n + 1) for n in periods]

    def fold(frame: pd.DataFrame, state: list[float] | None) -> dict[str, object]:
        x = _own(frame, column)
        starts = (state or [np.nan] * len(periods))[: len(periods)]
        return {f"EMA_{n}": _padded(frame, _ema(x, a, s)) for n, a, s in zip(periods, alphas, starts, strict=True)}

    def summary(frame: pd.DataFrame) -> list[float]:
        # values there are, and per period the end of the average begun at zero and at the first value
        x = _own(frame, column)
        return [float((~np.isnan(x)).sum()), *[_last(_ema(x, a, s)) for a in alphas for s in (0.0, np.nan)]]

    def combine(state: list[float] | None, block: list[float]) -> list[float]:
        n, *ends = block
        state = (state or [np.nan] * len(periods))[: len(periods)]
        after = [
            from_own if np.isnan(s) else s * (1 - a) ** n + from_zero
            for a, s, from_zero, from_own in zip(alphas, state, ends[::2], ends[1::2], strict=True)
        ]
        return after + [0.0] * (len(block) - len(after))

    def merge(left: list[float], right: list[float]) -> list[float]:
        n, out = right[0], [left[0] + right[0]]
        for a, zero, own, zero_after, own_after in zip(alphas, left[1::2], left[2::2], right[1::2], right[2::2], strict=True):
            out += [zero * (1 - a) ** n + zero_after, own_after if np.isnan(own) else own * (1 - a) ** n + zero_after]
        return out

    return Indicator(0, None, fold, (column,), tuple(f"EMA_{n}" for n in periods), summary, combine, 1 + 2 * len(periods), merge)


def macd_of(fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> Indicator:
    a, b, c = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)

    def lines(x: np.ndarray, state: list[float] | None) -> tuple[np.ndarray, ...]:
        starts = (state or [np.nan] * 3)[:3]
        quick, calm = _ema(x, a, starts[0]), _ema(x, b, starts[1])
        # where the value is missing the signal stays as it was too
        smooth = _ema(np.where(np.isnan(x), np.nan, quick - calm), c, starts[2])
        return quick, calm, smooth

    def fold(frame: pd.DataFrame, state: list[float] | None) -> dict[str, object]:
        quick, calm, smooth = lines(_own(frame, column), state)
        made = {"macd": quick - calm, "macd_signal": smooth, "macd_hist": quick - calm - smooth}
        return {n: _padded(frame, v) for n, v in made.items()}

    def summary(frame: pd.DataFrame) -> list[float]:
        x = _own(frame, column)
        n = int((~np.isnan(x)).sum())
        from_zero = [_last(v) for v in lines(x, [0.0] * 3)]
        from_own = [_last(v) for v in lines(x, None)]
        # what is left in the signal of averages that were 1 in front of the block
        step = np.arange(1, n + 1)
        echo = [_last(_ema((1 - alpha) ** step, c, 0.0)) if n else 0.0 for alpha in (a, b)]
        return [float(n), *from_zero, *from_own, *echo]

    def combine(state: list[float] | None, block: list[float]) -> list[float]:
        n, zero, own, echo = block[0], block[1:4], block[4:7], block[7:9]
        if not state or np.isnan(state[0]):
            after = own
        else:
            quick, calm, smooth = state[:3]
            after = [
                quick * (1 - a) ** n + zero[0],
                calm * (1 - b) ** n + zero[1],
                smooth * (1 - c) ** n + zero[2] + quick * echo[0] - calm * echo[1],
            ]
        return after + [0.0] * 6

    def merge(left: list[float], right: list[float]) -> list[float]:
        n = left[0]
        zero, own = combine(left[1:4], right)[:3], combine(left[4:7], right)[:3]
        echo = [
            e * (1 - c) ** right[0] + (1 - alpha) ** n * after
            for alpha, e, after in zip((a, b), left[7:], right[7:], strict=True)
        ]
        return [n + right[0], *zero, *own, *echo]

    return Indicator(0, None, fold, (column,), ("macd", "macd_signal", "macd_hist"), summary, combine, 9, merge)


def _shrunk(amounts: np.ndarray, at: np.ndarray, keep: float, start: float) -> np.ndarray:
    """``start`` and the amounts so far, each shrunk by ``keep`` per row since it came; ``at`` are rows behind ``start``.

    Sums are taken in stretches over which the factor stays a normal number.
    """
    if keep == 0:
        return amounts.copy()
    out, base, lo, span = np.empty(len(amounts)), 0.0, 0, max(1.0, 500 / -np.log(keep))
    while lo < len(amounts):
        hi = int(np.searchsorted(at, at[lo] + span))
        gone = at[lo:hi] - at[lo]
        out[lo:hi] = (np.cumsum(amounts[lo:hi] * keep**-gone) + start * keep ** (at[lo] - base)) * keep**gone
        start, base, lo = out[hi - 1], at[hi - 1], hi
    return out


def rsi_of(period: int = 14, column: str = "close") -> Indicator:
    keep = 1 - 1 / period

    def moves(frame: pd.DataFrame) -> np.ndarray:
        """Changes of own rows; a missing value on either side is no change."""
        x = frame[column].to_numpy("float64", na_value=np.nan)
        change = np.diff(x, prepend=np.nan)[frame["__own"].to_numpy()]
        return np.nan_to_num(change, nan=0.0)

    def walk(frame: pd.DataFrame, state: list[float] | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Mean gain and loss per row up to one common factor, and the state behind the block.

        A row without a change shrinks both alike, so it is only counted: their
        ratio survives runs without changes of any length.
        """
        change = moves(frame)
        first = int(frame["__pos"].to_numpy()[frame["__own"].to_numpy()][0]) if len(change) else 1
        gains, losses = np.full(len(change), np.nan), np.full(len(change), np.nan)
        gain, loss, still = state[:3] if state else (0.0, 0.0, 0.0)
        begin = 0
        if first == 1:
            begin = min(period + 1, len(change))
            if begin == period + 1:
                seed = change[1:begin]
                gain, loss = np.maximum(seed, 0).mean(), np.maximum(-seed, 0).mean()
                gains[period], losses[period] = gain, loss
        at = np.flatnonzero(change[begin:])
        moved, since = change[begin:][at], still + 1 + at
        ups = np.append(gain, _shrunk(np.maximum(moved, 0) / period, since, keep, gain))
        downs = np.append(loss, _shrunk(np.maximum(-moved, 0) / period, since, keep, loss))
        # rows without a change have the means of the last one
        held = np.cumsum(change[begin:] != 0)
        gains[begin:], losses[begin:] = ups[held], downs[held]
        gain, loss = float(ups[-1]), float(downs[-1])
        still = float(len(change) - begin - at[-1] - 1) if len(at) else still + len(change) - begin
        return gains, losses, [gain, loss, still]

    def fold(frame: pd.DataFrame, state: list[float] | None) -> dict[str, object]:
        gain, loss, _ = walk(frame, state)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            value = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        return {f"RSI_{period}": _padded(frame, np.where(np.isnan(gain), np.nan, value))}

    def summary(frame: pd.DataFrame) -> list[float]:
        return [float(frame["__own"].sum()), *walk(frame, None)[2]]

    def combine(state: list[float] | None, block: list[float]) -> list[float]:
        n, gain, loss, still = block
        if state:
            # rows up to the block's last change shrink what came before
            shrunk = keep ** (state[2] + n - still) if still < n else 1.0
            if still < n:
                gain, loss = state[0] * shrunk + gain, state[1] * shrunk + loss
            else:
                gain, loss, still = state[0], state[1], state[2] + n
        return [gain, loss, still, 0.0]

    def merge(left: list[float], right: list[float]) -> list[float]:
        return [left[0] + right[0], *combine(left[1:], right)[:3]]

    return Indicator(period + 1, None, fold, (column,), (f"RSI_{period}",), summary, combine, 4, merge)


def _rank_squares(windows: np.ndarray) -> np.ndarray:
    """Σ (place − rank)² of each window by comparing all its values; a missing value has rank ½."""
    squares = np.zeros(len(windows))
    for j in range(windows.shape[1]):
        mine = windows[:, j : j + 1]
        rank = (windows < mine).sum(axis=1) + ((windows == mine).sum(axis=1) + 1) / 2
        squares += (j + 1 - rank) ** 2
    return squares


def _sliding_squares(x: np.ndarray, periods: Sequence[int]) -> dict[int, np.ndarray]:
    """The same for the windows of every period over values none of which is missing, in time linear in the longest.

    Σ place · rank changes by what the value that leaves and the one that enters are compared with. Comparisons at a
    distance of m rows serve all windows of more than m rows, so all periods share one pass over the distances. All
    numbers are multiples of ½: sums are exact.
    """
    size = len(x)
    below, above, above_far, left_far, same_before, same_after = np.zeros((6, size))
    out, at = {}, 1
    for n in sorted(set(periods)):
        for at in range(at, min(n, size)):
            same = x[at:] == x[:-at]
            rises = (x[:-at] < x[at:]) + same / 2
            falls = 1 - rises
            below[at:] += rises
            above[at:] += falls
            above_far[at:] += at * falls
            left_far[:-at] += at * rises
            same_before[at:] += same
            same_after[:-at] += same
        at = min(n, size)
        if size < n:
            continue
        enters, leaves = slice(n, None), slice(0, size - n)
        step = n * above[enters] - above_far[enters] + n * (1 + below[enters]) - left_far[leaves] - n * (n + 1) / 2
        first = x[:n]
        rank = (first[None] < first[:, None]).sum(axis=1) + ((first[None] == first[:, None]).sum(axis=1) + 1) / 2
        placed = np.cumsum(np.append((np.arange(1, n + 1) * rank).sum(), step))
        cubes = lambda k: (k + 1) ** 3 - k**3
        ties = np.unique(first, return_counts=True)[1]
        tied = np.cumsum(np.append((ties**3).sum(), cubes(same_before[enters]) - cubes(same_after[leaves])))
        out[n] = n * (n + 1) * (2 * n + 1) / 3 - (tied - n) / 12 - 2 * placed
    return out


def rank_indices(x: np.ndarray, periods: Sequence[int]) -> dict[int, np.ndarray]:
    """Rank correlation with time of the last n values, per period; missing until n values exist."""
    squares = {n: np.full(len(x), np.nan) for n in periods}
    edges = np.flatnonzero(np.isnan(x))
    for lo, hi in zip(np.append(-1, edges) + 1, np.append(edges, len(x)), strict=True):
        for n, found in _sliding_squares(x[lo:hi], periods).items():
            squares[n][lo + n - 1 : hi] = found
    out = {}
    for n, values in squares.items():
        rest = np.flatnonzero(np.isnan(values[n - 1 :])) if len(x) >= n else np.zeros(0, np.int64)
        if len(rest):  # windows that hold a missing value
            values[rest + n - 1] = _rank_squares(np.lib.stride_tricks.sliding_window_view(x, n)[rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n] = (1 - 6 * values / (n * (n * n - 1))) * 100
    return out


def rci_of(period: int | Sequence[int] = RCI_PERIODS, column: str = "close") -> Indicator:
    periods = _periods(period)

    def fold(frame: pd.DataFrame, state: list[float] | None) -> dict[str, object]:
        del state
        x = frame[column].to_numpy(dtype="float64")
        return {f"RCI_{n}": values for n, values in rank_indices(x, periods).items()}

    return Indicator(max(periods) - 1, fold=fold, uses=(column,), adds=tuple(f"RCI_{n}" for n in periods))


# Functions on frames. ``options``: keys, slicing, block_rows.


def sma(bars: DataFrame, period: int | Sequence[int] = 20, column: str = "close", **options) -> DataFrame:
    """``SMA_n``: mean of the last n rows, null until n exist."""
    return add_indicators(bars, [sma_of(period, column)], **options)


def moving_averages(
    bars: DataFrame, period: int | Sequence[int] = MA_PERIODS, column: str = "close", **options
) -> DataFrame:
    """MA5 / MA20 / MA50. A symbol with fewer rows than n has nulls in ``MAn``."""
    return add_indicators(bars, [moving_averages_of(period, column)], **options)


def bollinger(
    bars: DataFrame, period: int = 20, width: float = 2.0, column: str = "close", **options
) -> DataFrame:
    """Mean, sample deviation and the bands ``width`` deviations away."""
    return add_indicators(bars, [bollinger_of(period, width, column)], **options)


def ema(
    bars: DataFrame, period: int | Sequence[int] = EMA_PERIODS, column: str = "close", **options
) -> DataFrame:
    """``EMA_n`` with α = 2/(n+1), started at the first value."""
    return add_indicators(bars, [ema_of(period, column)], **options)


def macd(
    bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", **options
) -> DataFrame:
    """EMA(fast) − EMA(slow), its EMA(signal), and the difference of the two."""
    return add_indicators(bars, [macd_of(fast, slow, signal, column)], **options)


def rsi(bars: DataFrame, period: int = 14, column: str = "close", **options) -> DataFrame:
    """Wilder's RSI: mean gain and loss of the first n changes, then α = 1/n.

    Null until n changes exist; 100 when there was no loss.
    """
    return add_indicators(bars, [rsi_of(period, column)], **options)


def rci(
    bars: DataFrame, period: int | Sequence[int] = RCI_PERIODS, column: str = "close", **options
) -> DataFrame:
    """``RCI_n`` = (1 − 6 Σd² / (n(n²−1))) · 100, d = time rank − price rank (ties averaged)."""
    return add_indicators(bars, [rci_of(period, column)], **options)


def latest(indicated: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "time") -> DataFrame:
    """The newest indicator row of each key."""
    return last_rows(indicated, keys, order, 1)


# --- dispatcher --------------------------------------------------------------

# Definitions are gathered into one pass; functions on frames run one by one.
REGISTRY: dict[str, Callable[..., Indicator | DataFrame]] = {
    "SMA": sma_of,
    "MA": moving_averages_of,
    "BOLLINGER": bollinger_of,
    "EMA": ema_of,
    "MACD": macd_of,
    "RSI": rsi_of,
    "RCI": rci_of,
}
_CUSTOM: set[str] = set()


def register(name: str, function: Callable[..., DataFrame]) -> None:
    """Make a function ``(bars, **params) → bars`` available to ``calculate_indicators``."""
    REGISTRY[name.upper()] = function
    _CUSTOM.add(name.upper())


def unregister(name: str) -> None:
    REGISTRY.pop(name.upper(), None)
    _CUSTOM.discard(name.upper())


def calculate_indicators(
    bars: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    slicing: Slicing = DEFAULT_SLICING,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    **params,
) -> DataFrame:
    """Add each named indicator. ``params`` hold a dict per name (``SMA={"period": 10}``) or
    values shared by the indicators that take them (``period=10``)."""
    wanted = [n.upper() for n in names]
    unknown = [n for n in wanted if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown indicators {unknown}; known: {sorted(REGISTRY)}")
    own = {k.upper(): v for k, v in params.items() if k.upper() in REGISTRY}
    shared = {k: v for k, v in params.items() if k.upper() not in REGISTRY}

    def options(name: str) -> dict:
        takes = inspect.signature(REGISTRY[name]).parameters
        return {k: v for k, v in shared.items() if k in takes} | own.get(name, {})

    together = [REGISTRY[n](**options(n)) for n in wanted if n not in _CUSTOM]
    if together:
        bars = add_indicators(bars, together, keys, slicing, block_rows)
    for n in wanted:
        if n in _CUSTOM:
            bars = REGISTRY[n](bars, **options(n))
    return bars
