"""Eigenvalues and eigenvectors of a symmetric matrix after a rank-one update."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
ROUNDS = 80


class Spectrum:
    """``vectors @ diag(values) @ vectors.T``, values rising, from nothing by rank-one updates."""

    def __init__(self, values: np.ndarray, vectors: np.ndarray) -> None:
        self.values, self.vectors = values, vectors

    @classmethod
    def nothing(cls, width: int) -> Spectrum:
        return cls(np.zeros(width), np.eye(width))

    def add(self, vector: np.ndarray) -> None:
        """Adds the product of ``vector`` with itself."""
        z = self.vectors.T @ vector
        size = z @ z
        if not size > 0:
            return
        least = 8 * EPS * max(self.values[-1], size)
        active = self._deflated(z, np.sqrt(size), least)
        if not len(active):
            return
        values, weights = secular_roots(self.values[active], z[active])
        self.values[active] = values
        self.vectors[:, active] = self.vectors[:, active] @ weights
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _deflated(self, z: np.ndarray, length: float, least: float) -> np.ndarray:
        """Places that the update changes; ``z`` is null elsewhere.

        A small entry of ``z`` changes nothing. Of two close values, a rotation of their vectors gives
        the whole of both entries to one.
        """
        z[length * np.abs(z) <= least] = 0
        active = np.flatnonzero(z)
        values = self.values
        while len(active) > 1:
            low, high = active[:-1], active[1:]
            both = z[low] ** 2 + z[high] ** 2
            close = np.flatnonzero((values[high] - values[low]) * np.abs(z[low] * z[high]) <= least * both)
            if not len(close):
                break
            for i in close:
                p, q = active[i], active[i + 1]
                r = np.hypot(z[p], z[q])
                c, s = z[q] / r, z[p] / r
                if (values[q] - values[p]) * abs(c * s) > least:
                    continue  # the rotation before this one has changed it
                z[p], z[q] = 0, r
                at = self.vectors[:, [p, q]]
                self.vectors[:, p] = c * at[:, 0] - s * at[:, 1]
                self.vectors[:, q] = s * at[:, 0] + c * at[:, 1]
                values[p], values[q] = (
                    c * c * values[p] + s * s * values[q],
                    s * s * values[p] + c * c * values[q],
                )
            active = np.flatnonzero(z)
            active = active[np.argsort(values[active], kind="stable")]
        return active


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``diag(d) + z z'``, for rising ``d`` and no zero in ``z``.

    Each eigenvalue is a root of ``1 + sum(z_j^2 / (d_j - x))``, one above every ``d``. All are sought at
    once, each as a distance from its nearest ``d``: a step goes to the root of the function with the same
    value and slopes that has but the two poles beside it, or halves the bracket where that leaves it.
    """
    k, square = len(d), z * z
    above = np.append(d[1:], d[-1] + square.sum())
    middle = (d + above) / 2
    left = 1 + (square / (d - middle[:, None])).sum(axis=1) > 0
    left[-1] = True
    origin = np.where(left, d, above)
    poles = d - origin[:, None]
    lower, upper = d - origin, above - origin
    low, high = np.where(left, 0.0, lower / 2), np.where(left, upper / 2, 0.0)
    high[-1] = upper[-1]
    x = (low + high) / 2
    own = np.tri(k, dtype=bool)
    for _ in range(ROUNDS):
        apart = poles - x[:, None]
        part = square / apart
        value = 1 + part.sum(axis=1)
        done = np.abs(value) <= 4 * EPS * (1 + np.abs(part).sum(axis=1))
        if done.all():
            break
        over = value > 0
        high, low = np.where(over, x, high), np.where(over, low, x)
        slopes = part / apart
        slope = slopes.sum(axis=1)
        below = np.where(own, slopes, 0).sum(axis=1)
        p, q = lower - x, upper - x
        c = value - p * below - q * (slope - below)
        a, b = (p + q) * value - p * q * slope, p * q * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = x + step
        moved = np.where((moved > low) & (moved < high), moved, (low + high) / 2)
        moved = np.where(done, x, moved)
        if (moved == x).all():
            break
        x = moved
    apart = poles - x[:, None]
    # the z for which the roots found are exact, so that the eigenvectors come out orthogonal
    gaps = np.abs(d[:, None] - d)
    beside = np.where(np.tri(k, k, -1, dtype=bool).T, gaps, np.vstack([gaps[1:], np.ones(k)]))
    exact = np.sqrt(np.prod(np.abs(apart) / beside, axis=0)) * np.sign(z)
    weights = (exact / apart).T
    return origin + x, weights / np.sqrt((weights * weights).sum(axis=0))
