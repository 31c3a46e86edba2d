"""Linear classifiers over hashed character n-grams: training on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: row ``i`` holds ``slots[starts[i]:starts[i + 1]]`` and the same values."""

    slots: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])]).astype(np.int64)
        slots = np.concatenate([np.zeros(0, np.int32), *[s for s, _ in rows]])
        values = np.concatenate([np.zeros(0, np.float32), *[v for _, v in rows]])
        return cls(slots, values, starts)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.slots[a:b], self.values[a:b]


def softmax(scores: np.ndarray) -> np.ndarray:
    moved = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return moved / moved.sum(axis=-1, keepdims=True)


def ftrl(
    rows: Rows,
    labels: np.ndarray,
    classes: int,
    slots: int,
    *,
    epochs: int,
    alpha: float,
    beta: float,
    l1: float,
    l2: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic weights (slots x classes) and biases.

    Follow-the-regularised-leader: every coordinate keeps the sum ``z`` of its adjusted
    gradients and the sum ``n`` of their squares; its weight is the minimiser under the elastic
    net, which is exactly 0 while ``|z| <= l1``.
    """
    z, n = np.zeros((slots + 1, classes)), np.zeros((slots + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        pulled = z[at] - np.sign(z[at]) * l1
        return np.where(
            np.abs(z[at]) <= l1, 0.0, -pulled / ((beta + np.sqrt(n[at])) / alpha + l2)
        )

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows.row(i)
            at, x = np.append(at, slots), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(slots + 1))
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes held-back labels most likely."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(scores / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high = np.log(0.05), np.log(20.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))
