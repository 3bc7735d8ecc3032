"""Small linear models fitted on a bounded sample, on the driver."""

from __future__ import annotations

import numpy as np


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate descent; ``y`` is -1 or 1.

    Classes weigh the same, however many rows they have. The last column of ``x`` should be a constant.
    """
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    diagonal = share / cost
    norms = np.einsum("ij,ij->i", x, x) + diagonal
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; ``y`` is 0 or 1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The positive factor that makes margins log odds; ``y`` is -1 or 1."""
    steps = np.geomspace(0.5, 64, 43)
    loss = [np.logaddexp(0, -s * y * margin).mean() for s in steps]
    return float(steps[int(np.argmin(loss))])
