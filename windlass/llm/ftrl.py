"""FTRL-proximal updates with elastic-net penalties (McMahan et al., 2013),
shared by the trainers.  State arrays are indexed by the active features."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of shape (features, outputs), kept as the usual (z, n)."""

    def __init__(self, features: int, outputs: int, alpha=0.5, beta=1.0, l1=1.0, l2=1.0):
        self.z, self.n = np.zeros((features, outputs)), np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more
