"""Sparse multinomial logistic regression trained by follow-the-regularised-
leader with elastic-net penalties, and temperature calibration. Plain numpy on
a bounded sample; the learned weights are small and go to the tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Weights of ``classes`` columns over ``features`` rows. The last feature
    row is the bias, which is not penalised."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0,
                 l1: float = 0.02, l2: float = 0.05) -> None:
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def rows(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.sign(z) * np.maximum(np.abs(z) - np.where(at == len(self.z) - 1, 0, self.l1)[:, None], 0)
        return -pull / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.rows(at)
        gap = softmax(value @ w)
        gap[label] -= 1
        g = value[:, None] * gap
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int],
            epochs: int, seed: int = 5) -> np.ndarray:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.step(*rows[i], labels[i])
        return self.weights()

    def weights(self) -> np.ndarray:
        return self.rows(np.arange(len(self.z)))


def scores(weights: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value @ weights[at] + weights[-1]


def temperature(raw: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-out
    scores, by golden-section search on its logarithm; 1 if there are none."""
    if not len(raw):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(raw / np.exp(t))[np.arange(len(raw)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).sum())

    lo, hi, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
