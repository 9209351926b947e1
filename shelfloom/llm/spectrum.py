"""Eigendecompositions of scatter matrices that grow by one vector at a time.

A spectrum holds the count, the mean, and the eigenvalues and eigenvectors of the centred scatter of what it
has taken in. A vector changes the scatter by a matrix of rank one, so that the new eigenvalues are the roots
of a secular equation, one between each two of the old ones; parts that such a change doesn't reach are
deflated. Two spectra join by one such change for each eigenvector of the second and one for the difference
of the means.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots m of 1 + sum(weights / (poles - m)), one after each pole, and the matrix poles[k] - root[i] without cancellation.

    poles ascend strictly and weights are positive. Each root is sought from its nearer pole: the sums on
    either side of it are replaced by simple fractions with the same value and slope, and what leaves the
    known bracket is bisected.
    """
    m = len(poles)
    row = np.arange(m)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    half = (upper - poles) / 2
    from_left = 1 + (weights / (poles - (poles + half)[:, None])).sum(1) >= 0
    from_left[-1] = True
    origin = np.where(from_left, poles, upper)
    away = poles - origin[:, None]
    left, right = poles - origin, upper - origin
    low, high = np.where(from_left, 0.0, -half), np.where(from_left, half, 0.0)
    high[-1] = 2 * half[-1]
    step = (low + high) / 2
    before = (row[None, :] <= row[:, None]).astype(np.float64)
    for _ in range(80):
        gap = away - step[:, None]
        inverse = 1 / gap
        value = 1 + inverse @ weights
        done = np.abs(value) <= 8 * EPS * (1 + np.abs(inverse) @ weights)
        if done.all():
            break
        low, high = np.where(value < 0, step, low), np.where(value < 0, high, step)
        inverse *= inverse
        slope = inverse @ weights
        one = (inverse * before) @ weights
        other = slope - one
        d1, d2 = left - step, right - step
        c = value - d1 * one - d2 * other
        a = (d1 + d2) * value - d1 * d2 * slope
        b = d1 * d2 * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = step + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(done, step, np.where((new > low) & (new < high), new, (low + high) / 2))
    return origin + step, away - step[:, None]


def rank_one(values: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of diag(values) + weight * z z'; values ascend in and out."""
    m = len(values)
    turn = np.eye(m)
    z, new = z.copy(), values.copy()
    size = np.sqrt((z * z).sum())
    most = max(np.abs(values).max(initial=0), weight * size * size)
    least = 8 * EPS * most
    live = np.flatnonzero(weight * np.abs(z) * size > least)  # what z hardly touches stays as it is
    if len(live) > 1 and np.diff(values[live]).min() <= least:
        kept = []  # equal values: a rotation moves all of z into the later of the two
        for k in live:
            if kept and values[k] - values[kept[-1]] <= least:
                j = kept.pop()
                r = np.hypot(z[j], z[k])
                c, s = z[k] / r, z[j] / r
                turn[:, [j, k]] = np.stack((c * turn[:, j] - s * turn[:, k], s * turn[:, j] + c * turn[:, k]), 1)
                z[j], z[k] = 0, r
            kept.append(k)
        live = np.array(kept)
    if len(live):
        roots, gap = secular_roots(values[live], weight * z[live] ** 2)
        # the z for which these roots are exact, so that vectors are orthogonal however close the roots are
        poles, n = values[live], len(live)
        row = np.arange(n)
        paired = np.append(poles[1:], poles[-1] + 1)[:, None] - poles
        paired[-1] = 1
        under = row[:, None] < row
        paired[under] = (poles[:, None] - poles)[under]
        exact = np.copysign(np.sqrt(np.abs((-gap / paired).prod(0))), z[live])
        vectors = (exact / gap).T
        vectors /= np.sqrt((vectors**2).sum(0))
        turn[:, live] = turn[:, live] @ vectors
        new[live] = roots
    order = np.argsort(new, kind="stable")
    return new[order], turn[:, order]


class Spectrum:
    """count, mean, values (ascending) and vectors (columns) of the scatter of what was taken in; at most `rank` vectors are kept."""

    def __init__(self, size: int, rank: int):
        self.count, self.mean, self.rank = 0, np.zeros(size), min(rank, size)
        self.values, self.vectors = np.zeros(0), np.zeros((size, 0))

    def change(self, y: np.ndarray, weight: float) -> None:
        """Adds weight * y y' to the scatter."""
        size = np.sqrt(y @ y)
        if not size * size * weight > 0:
            return
        z = self.vectors.T @ y
        rest = y - self.vectors @ z
        again = self.vectors.T @ rest
        z, rest = z + again, rest - self.vectors @ again
        values, vectors = self.values, self.vectors
        over = np.sqrt(rest @ rest)
        if vectors.shape[1] < len(y) and over > 1e-10 * size:
            values, vectors = np.concatenate(([0.0], values)), np.concatenate(((rest / over)[:, None], vectors), 1)
            z = np.concatenate(([over], z))
        values, turn = rank_one(values, z, weight)
        drop = max(0, len(values) - self.rank)
        self.values, self.vectors = np.maximum(values[drop:], 0), vectors @ turn[:, drop:]

    def take(self, x: np.ndarray) -> None:
        """Takes in one vector."""
        away = x - self.mean
        self.count += 1
        self.mean = self.mean + away / self.count
        if self.count > 1:
            self.change(away, (self.count - 1) / self.count)

    def join(self, other: Spectrum) -> None:
        """Takes in all that another spectrum has."""
        away, both = other.mean - self.mean, self.count + other.count
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1], strict=True):
            self.change(vector, value)
        if self.count and other.count:
            self.change(away, self.count * other.count / both)
        self.mean, self.count = self.mean + away * (other.count / both), both
