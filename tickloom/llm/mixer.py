"""Online logistic mixing of bit predictors, vectorised over many bits.

Predictions are log odds. A gate chooses the weights for each bit; weights follow an online Newton step over the bits
learnt so far, and an adaptive table refines the mixed prediction by what bits of like predictions turned out to be.
"""

from __future__ import annotations

import numpy as np

STEPS = 33  # cells of the refinement over log odds of -8 to 8


def taken(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values[places]`` of places within it, without the bounds check: a few times faster."""
    return values.take(places, mode="clip")


class Mixer:
    def __init__(self, gates: int, start: list[float]) -> None:
        k = len(start)
        self.start = (gates, start)
        self.weights = np.tile(np.array(start, np.float32), (gates, 1))
        self.curve = np.tile(np.eye(k) * 200.0, (gates, 1, 1))
        centre = np.linspace(-8, 8, STEPS)
        self.ones = np.tile(20.0 / (1 + np.exp(-centre)), (gates, 1))
        self.all = np.full((gates, STEPS), 20.0)

    def _state(self) -> np.ndarray:
        pull = (self.curve @ self.weights[..., None].astype(np.float64))[..., 0]
        return np.concatenate([x.ravel() for x in (self.curve, pull, self.ones, self.all)])

    def sums(self) -> np.ndarray:
        """All that was learnt, as numbers that add up: a Newton step leaves curve times weights as a plain sum over bits."""
        return self._state() - Mixer(*self.start)._state()

    def add(self, sums: np.ndarray) -> None:
        """Learn what other mixers of the same start have learnt: the sum of their ``sums()``."""
        state, at = self._state() + sums, 0
        pull = np.empty(self.weights.shape)
        for x in (self.curve, pull, self.ones, self.all):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size
        self.weights = np.linalg.solve(self.curve, pull[..., None])[..., 0].astype(np.float32)

    @staticmethod
    def _cell(odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        cell = np.clip(odds, -8, 8)
        cell += np.float32(8.25)
        cell *= np.float32(2)
        cell = cell.astype(np.int32)
        cell += gate * np.int32(STEPS)
        return cell

    def odds(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        gate = gate.astype(np.intp)
        weights = np.ascontiguousarray(self.weights.T)
        total = taken(weights[0], gate) * inputs[0]
        for k in range(1, len(inputs)):
            total += taken(weights[k], gate) * inputs[k]
        return np.clip(total, -14, 14, out=total)

    def costs(self, inputs: list[np.ndarray], gate: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Nats that each bit costs; ``sign`` is 1 for a one and -1 for a zero."""
        odds = self.odds(inputs, gate)
        table = (self.ones / self.all).ravel()
        # the refined probability of the bit that came, for zeros behind those for ones
        table = np.concatenate([table, 1 - table]).astype(np.float32)
        cell = self._cell(odds, gate)
        cell += (sign < 0) * np.int32(len(table) // 2)
        odds *= -sign
        np.exp(odds, out=odds)
        odds += np.float32(1)
        np.divide(np.float32(1), odds, out=odds)
        odds += taken(table, cell.astype(np.intp))
        odds *= np.float32(0.5)
        np.log(odds, out=odds)
        return np.negative(odds, out=odds)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        """One step towards bits seen, each as often as ``times`` says; what is learnt earlier weighs by its own curvature."""
        if not len(bit):
            return
        gates, k = self.weights.shape
        # bits of a gate side by side: its weights repeat, and sums over it are sums over a stretch
        gate = gate.astype(np.uint8)
        order = np.argsort(gate, kind="stable")
        size = np.bincount(gate, minlength=gates)
        used = np.flatnonzero(size)
        size = size[used]
        start = np.cumsum(size) - size
        inputs, bit = [taken(x, order) for x in inputs], taken(bit, order)
        times = np.ones(len(bit), np.float32) if times is None else taken(times, order)
        odds = np.repeat(self.weights[used, 0], size) * inputs[0]
        for i in range(1, k):
            odds += np.repeat(self.weights[used, i], size) * inputs[i]
        np.clip(odds, -14, 14, out=odds)
        cells = self._cell(odds, np.repeat(used.astype(np.int32), size))
        cells *= 2
        cells += bit.astype(np.int32)
        seen = np.bincount(cells, times, 2 * gates * STEPS).reshape(gates, STEPS, 2)
        self.ones += seen[..., 1]
        self.all += seen.sum(axis=2)
        p = 1 / (1 + np.exp(-odds))
        error = (bit - p) * times
        spread = p * (1 - p) * times
        gradient = np.zeros((gates, k))
        for i in range(k):
            gradient[used, i] = np.add.reduceat(error * inputs[i], start)
            bent = spread * inputs[i]
            for j in range(i, k):
                added = np.add.reduceat(bent * inputs[j], start)
                self.curve[used, i, j] += added
                if i != j:
                    self.curve[used, j, i] += added
        self.weights += np.linalg.solve(self.curve, gradient[..., None])[..., 0].astype(np.float32)


def stretch(one: np.ndarray, zero: np.ndarray, prior: np.ndarray | np.float32, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability and log odds of a one after counts, leaning on ``prior`` as on ``weight`` bits."""
    weight = np.float32(weight)
    p = prior * weight
    p = p + one
    total = zero + one
    total += weight
    p /= total
    np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)
    odds = 1 - p
    np.divide(p, odds, out=odds)
    return p, np.log(odds, out=odds)


def ratio(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The log odds of ``stretch``, where the counts include the prior bits already; ``one`` is overwritten."""
    one /= zero
    np.clip(one, np.float32(1e-6), np.float32(1e6), out=one)
    return np.log(one, out=one)


def confidence(total: np.ndarray) -> np.ndarray:
    """None, few, some or many bits seen: 0 to 3."""
    level = (total > 0).view(np.uint8)
    level += (total > 3).view(np.uint8)
    level += (total > 24).view(np.uint8)
    return level
