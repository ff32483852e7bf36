"""Small linear models on bounded samples: sparse rows in numpy, fitted by Adam. Runs on the driver."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: column numbers and values, and where each row begins."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in columns], np.int64)
        self.columns = np.concatenate(columns) if columns else np.zeros(0, np.int32)
        self.values = np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32)
        self.row = np.repeat(np.arange(len(columns), dtype=np.int32), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns] * self.values, len(self))

    def back(self, errors: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, errors[self.row] * self.values, width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def adam(start: np.ndarray, gradient, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def logistic(rows: Rows, y: np.ndarray, width: int, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one the bias. weight: how much each row counts; start: weights to begin with."""
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1.0)

    def gradient(w: np.ndarray) -> np.ndarray:
        errors = (sigmoid(rows.dot(w[:-1]) + w[-1]) - y) * weight / total
        return np.append(rows.back(errors, width) + l2 * w[:-1], errors.sum())

    return adam(np.zeros(width + 1) if start is None else start, gradient, steps)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into calibrated log odds."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    spread = z.std() or 1.0
    one = Rows([np.zeros(1, np.int32)] * len(z), [np.array([v / spread]) for v in z])
    w = logistic(one, y, 1, l2=1e-2, steps=300)
    return max(float(w[0]) / spread, 1e-3), float(w[1])


def ordinal(rows: Rows, grades: np.ndarray, width: int, levels: int, l2: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link regression: P(grade > k) = sigmoid(x w - cut[k]) with one w for all k and rising cuts.

    Cuts are fitted as the first cut and the logarithms of the gaps, so they stay in order.
    """
    n = max(len(grades), 1)

    def split(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = np.exp(np.clip(p[width + 1 :], -5, 5))
        return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(gaps)])

    def gradient(p: np.ndarray) -> np.ndarray:
        w, cuts = split(p)
        z = rows.dot(w)
        # grade probabilities are differences of neighbouring curves; the likelihood's slope in z and in each cut
        curve = np.concatenate([np.ones((len(z), 1)), sigmoid(z[:, None] - cuts[None, :]), np.zeros((len(z), 1))], axis=1)
        slope = curve * (1 - curve)
        at = np.arange(len(z))
        chance = np.maximum(curve[at, grades] - curve[at, grades + 1], 1e-9)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / chance / n
        dcut = np.zeros((len(z), levels + 1))
        dcut[at, grades] += slope[at, grades] / chance / n
        dcut[at, grades + 1] -= slope[at, grades + 1] / chance / n
        dcuts = dcut[:, 1:-1].sum(axis=0)
        gaps = np.exp(np.clip(p[width + 1 :], -5, 5))
        dgaps = np.array([dcuts[k + 1 :].sum() for k in range(levels - 2)]) * gaps
        return np.concatenate([rows.back(dz, width) + l2 * w, [dcuts.sum()], dgaps])

    start = np.concatenate([np.zeros(width), [1.0], np.zeros(levels - 2)])
    return split(adam(start, gradient, steps))
