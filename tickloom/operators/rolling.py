"""Moments of long row windows in time that does not grow with the window."""

from __future__ import annotations

import numpy as np


def _cumulative(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of the first 1, 2, … rows of each column."""
    mean, square = np.empty_like(columns), np.empty_like(columns)
    m, q = np.zeros(columns.shape[1]), np.zeros(columns.shape[1])
    for i, x in enumerate(columns):
        step = x - m
        m = m + step / (i + 1)
        q = q + step * (x - m)
        mean[i], square[i] = m, q
    return mean, square


def moments_up_to(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sample deviation of the last ``n`` values up to each position.

    The values are laid out in runs of ``n``. A window is the tail of one run and
    the head of the next, whose moments are merged; nothing is subtracted, so a
    window of equal values has a deviation of exactly zero. The deviation of a
    single value is 0.
    """
    size = len(x)
    runs = -(-size // n)
    padded = np.full(runs * n, x[-1] if size else 0.0)
    padded[:size] = x
    grid = padded.reshape(runs, n).T  # one run per column
    head_mean, head_square = _cumulative(grid)
    tail_mean, tail_square = _cumulative(grid[::-1])
    at = np.arange(size)
    run, row = at // n, at % n
    count = np.minimum(at + 1, n)
    head, tail = row + 1, count - (row + 1)
    mean, square = head_mean[row, run], head_square[row, run]
    both = tail > 0
    t, r = tail[both] - 1, run[both] - 1
    other_mean, other_square = tail_mean[t, r], tail_square[t, r]
    step, share = mean[both] - other_mean, tail[both] / count[both]
    square[both] += other_square + step * step * head[both] * share
    mean[both] -= step * share
    std = np.sqrt(square / np.maximum(count - 1, 1))
    return count, mean, std


def moments_before(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the ``n`` values before each position; the first position has none."""
    count, mean, std = moments_up_to(x, n)
    return (
        np.concatenate(([0], count[:-1])),
        np.concatenate(([0.0], mean[:-1])),
        np.concatenate(([0.0], std[:-1])),
    )
