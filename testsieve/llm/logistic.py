"""Softmax regression on a small matrix (the bounded sample of labelled rows)."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray | None = None, centre: np.ndarray | None = None,
                decay: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights (features x classes) of the penalised fit of rows ``x`` to classes ``y``:
    a Gaussian prior around ``centre``; momentum steps of a size that the features bound."""
    n = np.ones(len(x)) if weight is None else weight.astype(float)
    n = n / n.sum()
    w = np.zeros((x.shape[1], classes)) if centre is None else centre.copy()
    start, speed = w.copy(), np.zeros_like(w)
    target = np.eye(classes)[y]
    rate = 2.0 / (float((n[:, None] * x * x).sum()) + decay)
    for _ in range(steps):
        ahead = w + 0.9 * speed
        grad = x.T @ (n[:, None] * (softmax(x @ ahead) - target)) + decay * (ahead - start)
        speed = 0.9 * speed - 0.5 * rate * grad
        w = w + speed
    return w
