"""Palettes of one image that is held as an array: the rule of ``palette.kmeans``, sample by sample in order, for pipelines that run image by image."""

from __future__ import annotations

import numpy as np

from .palette import CONVERGED_SQ, DUPLICATE, MAX_ITERATIONS, MAX_SAMPLES, SEED


class Random32:
    """The seeded 32-bit generator that makes palettes reproducible."""

    def __init__(self, seed: int = SEED):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        mul = lambda a, b: (a * b) & 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = mul(t ^ (t >> 15), t | 1)
        t ^= (t + mul(t ^ (t >> 7), t | 61)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64) - c.astype(np.float64)
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def _draw(weights: np.ndarray, target: float) -> int:
    """The first element at which the running sum reaches the target; the last one if rounding keeps it from that."""
    reached = np.flatnonzero(target - np.cumsum(weights.astype(np.float64)) <= 0)
    return int(reached[0]) if len(reached) else -1


def spread_start(x: np.ndarray, k: int, draw: Random32) -> np.ndarray:
    """k-means++ starting points."""
    first = max(0, _draw(np.ones(len(x)), draw() * len(x)))
    out = [x[first]]
    least = np.full(len(x), np.inf, np.float32)
    while len(out) < k:
        least = np.minimum(least, _far(x, out[-1]).astype(np.float32))
        total = float(np.cumsum(least.astype(np.float64))[-1])
        if total == 0:
            out.append(out[0])
        else:
            at = _draw(least, draw() * total)
            out.append(x[at if at >= 0 else len(x) - 1])
    return np.array(out, np.float32)


def kmeans(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Palette of float32 Lab rows: every stride-th sample, seeded start, Lloyd steps, near-equal colours merged. No rows give none."""
    if not len(x):
        return np.empty((0, 3), np.float32)
    x = x[:: max(1, len(x) // MAX_SAMPLES)].astype(np.float32)
    k = min(k, len(x))
    c = spread_start(x, k, Random32(seed))
    count = np.zeros(k)
    for _ in range(MAX_ITERATIONS):
        own = np.stack([_far(x, m) for m in c], 1).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j].astype(np.float64), k) for j in range(3)], 1)
        used = count > 0
        mean = np.where(used[:, None], total / np.maximum(count, 1)[:, None], c)
        moved = ((mean - c.astype(np.float64)) ** 2).sum(1).max()
        c = mean.astype(np.float32)
        if moved < CONVERGED_SQ:
            break
    kept: list[int] = []
    for i in range(k):
        if count[i] and not any(_far(c[i : i + 1], c[j])[0] < DUPLICATE**2 for j in kept):
            kept.append(i)
    return c[kept or [0]]


def assign_grid(lab: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each pixel of a (h, w, 3) image; ties go to the lowest index."""
    flat = lab.reshape(-1, 3)
    best, least = np.zeros(len(flat), np.int64), np.full(len(flat), np.inf)
    for i, m in enumerate(c):
        d = _far(flat, m)
        best, least = np.where(d < least, i, best), np.minimum(d, least)
    return best.reshape(lab.shape[:2])
