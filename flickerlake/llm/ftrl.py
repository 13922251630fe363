"""Follow-the-regularised-leader training of sparse linear models on the driver.

Per-coordinate FTRL-proximal: from the gradient sums z and squared sums n of a coordinate, its weight
is zero while |z| <= l1 and otherwise -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2). Training
data are a bounded sample of sparse rows, held as index and value arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


class Ftrl:
    """Multinomial logistic regression over ``classes``; two classes or more."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # the last coordinate is the intercept, which no penalty touches
        self.z = np.zeros((dims + 1, classes), np.float32)
        self.n = np.zeros((dims + 1, classes), np.float32)

    def _weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / (rate + self.l2))

    def _bias(self) -> np.ndarray:
        return -self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1]))

    def step(self, row: Row, label: int) -> None:
        at, x = row
        w, b = self._weights(at), self._bias()
        p = softmax(x @ w + b)
        p[label] -= 1.0
        for where, g, old in ((at, x[:, None] * p, w), (-1, p, b)):
            n = self.n[where]
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
            self.z[where] += g - sigma * old
            self.n[where] = n + g * g

    def fit(self, rows: list[Row], labels: list[int], epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """Weights (dims, classes) and intercepts; the order of steps depends on ``seed`` alone."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                self.step(rows[k], labels[k])
        return self._weights(slice(0, -1)), self._bias()


def settled(ids: list[int], content: Callable[[int], tuple]) -> list[int]:
    """Positions in order of their ids; those that share one go by what they hold, which only they are asked for."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    repeated = {i for i, n in Counter(ids).items() if n > 1}
    return sorted(order, key=lambda k: (ids[k], *(content(k) if ids[k] in repeated else ()))) if repeated else order


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that weren't trained on."""
    if not len(labels):
        return 1.0
    # one further row counts as right and one as wrong, so that certainty has to be earned
    right = (len(labels) + 1) / (len(labels) + 2)
    grid = np.geomspace(0.02, 20, 200)
    true = [np.clip(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12, 1 - 1e-12) for t in grid]
    loss = [-(right * np.log(p) + (1 - right) * np.log(1 - p)).mean() for p in true]
    return float(grid[int(np.argmin(loss))])
