"""Logistic regression over sparse rows, for samples of bounded size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: entries of row i are at starts[i] to starts[i + 1]."""

    columns: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    width: int

    @classmethod
    def of(cls, columns: list, values: list, width: int) -> Rows:
        sizes = [len(c) for c in columns]
        join = lambda xs, kind: np.concatenate([np.zeros(0, kind), *[np.asarray(x, kind) for x in xs]])
        return cls(join(columns, np.int64), join(values, np.float64), np.cumsum([0, *sizes]), width)

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def take(self, keep: np.ndarray) -> Rows:
        entries = keep[self.rows]
        return Rows(self.columns[entries], self.values[entries], np.cumsum([0, *np.diff(self.starts)[keep]]), self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    weights: np.ndarray
    dense: np.ndarray  # weights of further dense columns
    bias: float

    def logits(self, x: Rows, dense: np.ndarray) -> np.ndarray:
        return np.bincount(x.rows, x.values * self.weights[x.columns], len(x)) + dense @ self.dense + self.bias


def fit(x: Rows, dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.3) -> Linear:
    """Full-batch Adam on the log loss; ``y`` may be soft. Without rows, the prior is even."""
    n, rows = max(1, len(x)), x.rows
    w = np.zeros(x.width + dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        model = Linear(w[: x.width], w[x.width : -1], w[-1])
        r = (sigmoid(model.logits(x, dense)) - y) / n
        g = np.concatenate([np.bincount(x.columns, x.values * r[rows], x.width), dense.T @ r, [r.sum()]])
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(w[: x.width], w[x.width : -1], float(w[-1]))
