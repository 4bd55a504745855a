"""A small weighted logistic-regression solver for searches that fit thousands of models."""

from __future__ import annotations

import numpy as np


def expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, penalty: str, weights: np.ndarray | None = None, rounds: int = 400, tolerance: float = 1e-7) -> np.ndarray:
    """Minimize c * sum of weighted logistic losses + |w|_1 or |w|_2^2 / 2, the last weight being the penalized intercept.

    Accelerated proximal gradients with restarts; the step is the inverse of a bound on the curvature.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    mass = np.ones(len(x)) if weights is None else weights
    bound = c * 0.25 * float(np.linalg.eigvalsh((a * mass[:, None]).T @ a)[-1]) + (penalty == "l2")
    step = 1 / max(bound, 1e-12)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        slope = -c * (a.T @ (mass * sign * expit(-sign * (a @ z))))
        if penalty == "l2":
            new = z - step * (slope + z)
        else:
            new = z - step * slope
            new = np.sign(new) * np.maximum(np.abs(new) - step, 0)
        if (z - new) @ (new - w) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = new - w
        z, w, t = new + (t - 1) / after * moved, new, after
        if np.abs(moved).max(initial=0) <= tolerance * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return expit(x @ w[:-1] + w[-1])


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights n / (2 n_class) of the rows."""
    n1 = max(int((y > 0).sum()), 1)
    n0 = max(len(y) - n1, 1)
    return np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))
