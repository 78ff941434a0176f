"""Turning raw scores of a classifier into probabilities."""

from __future__ import annotations

import numpy as np


def platt(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """``(a, b)`` such that ``sigmoid(a * raw + b)`` is calibrated on 0/1 labels.

    Platt's smoothed targets, held near the identity by a ridge. Newton steps,
    halved until they lower the loss: the classes may be separable, where the free
    optimum lies at infinity. A falling curve is refused in favour of the identity.
    """
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([raw, np.ones_like(raw)])
    at, centre, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([1.0, 0.1])

    def loss(ab: np.ndarray) -> float:
        z = ab @ x
        return float((np.logaddexp(0, z) - target * z).sum() + (ridge * (ab - centre) ** 2).sum() / 2)

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        slope = x @ (p - target) + ridge * (at - centre)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag(ridge), slope)
        while np.abs(step).max() > 1e-7 and loss(at - step) > loss(at):
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-6:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)
