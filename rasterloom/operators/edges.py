"""Feature lines and dark marks of a lightness image, and disc morphology, on one image."""

from __future__ import annotations

import numpy as np

from .grid import AROUND_8, area_of, components, shifted

# The five taps of the blur, and the neighbour compared for each direction of the gradient. The two diagonals are
# the other way round than geometry asks; ``strict_diagonals`` puts them right.
TAPS = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)
COMPARE = ((1, 0), (1, -1), (0, 1), (1, 1))


def blur(lum: np.ndarray) -> np.ndarray:
    """Separable five-tap blur; borders are repeated."""
    for axis in (1, 0):
        wide = np.pad(lum.astype(np.float64), [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = lum.shape[axis]
        lum = sum(k * np.take(wide, range(t, t + n), axis) for t, k in enumerate(TAPS)).astype(np.float32)
    return lum


def gradient(lum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel magnitude (float32) and direction 0-3; 0 on the border."""
    b = lum.astype(np.float64)
    s = lambda dx, dy: shifted(b, dx, dy, 0.0)
    gx = -s(-1, -1) + s(1, -1) - 2 * s(-1, 0) + 2 * s(1, 0) - s(-1, 1) + s(1, 1)
    gy = -s(-1, -1) - 2 * s(0, -1) - s(1, -1) + s(-1, 1) + 2 * s(0, 1) + s(1, 1)
    inner = np.zeros(lum.shape, bool)
    inner[1:-1, 1:-1] = True
    mag = np.where(inner, np.hypot(gx, gy), 0).astype(np.float32)
    way = np.where(inner, np.floor(np.arctan2(gy, gx) / np.pi * 4 + 0.5).astype(int) % 4, 0)
    return mag, way


def thin(mag: np.ndarray, way: np.ndarray, strict_diagonals: bool = False) -> np.ndarray:
    """Magnitudes that are no smaller than those of both neighbours along the gradient."""
    out = np.zeros_like(mag)
    inner = np.zeros(mag.shape, bool)
    inner[1:-1, 1:-1] = True
    for d, (dx, dy) in enumerate(COMPARE):
        if strict_diagonals and d in (1, 3):
            dx, dy = COMPARE[4 - d]
        top = (mag >= shifted(mag, -dx, -dy, np.float32(0))) & (mag >= shifted(mag, dx, dy, np.float32(0)))
        out = np.where(inner & (way == d) & (mag != 0) & top, mag, out)
    return out


def percentile(values: np.ndarray, p: float) -> float:
    """The value at index min(n - 1, floor(n * p)) in ascending order."""
    v = np.sort(values)
    return v[min(len(v) - 1, int(np.floor(len(v) * p)))]


def feature_lines(lum: np.ndarray, focus: np.ndarray | None = None, strong: float = 0.95, weak: float = 0.85, min_chain: int = 20) -> np.ndarray:
    """Thin edges that hang together with a strong one; chains shorter than ``min_chain`` are dropped."""
    t = thin(*gradient(blur(lum)))
    seen = np.ones(t.shape, bool) if focus is None else focus > 128
    values = t[(t > 0) & seen]
    if not len(values):
        return np.zeros(t.shape, bool)
    hi, lo = percentile(values, strong), percentile(values, weak)
    return long_chains(grown((t >= lo) & seen, (t >= hi) & seen), min_chain)


def grown(weak: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """8-connected components of ``weak`` or ``strong`` that hold a strong pixel."""
    either = weak | strong
    label = components(either.astype(np.int64), either, AROUND_8)
    return either & np.isin(label, np.unique(label[strong]))


def long_chains(mask: np.ndarray, least: int) -> np.ndarray:
    return mask & (area_of(components(mask.astype(np.int64), mask, AROUND_8)) >= least)


def compact_components(mask: np.ndarray, least: float, most: float, fill: float = 0.3) -> np.ndarray:
    """8-connected components of bounded area that fill enough of their bounding box."""
    label = components(mask.astype(np.int64), mask, AROUND_8)
    out = np.zeros(mask.shape, bool)
    y, x = np.nonzero(mask)
    if not len(y):
        return out
    names, own, n = np.unique(label[mask], return_inverse=True, return_counts=True)
    lo = [np.full(len(names), 1 << 40), np.full(len(names), 1 << 40)]
    hi = [np.full(len(names), -1), np.full(len(names), -1)]
    for k, v in enumerate((x, y)):
        np.minimum.at(lo[k], own, v)
        np.maximum.at(hi[k], own, v)
    box = (hi[0] - lo[0] + 1) * (hi[1] - lo[1] + 1)
    out[y, x] = ((n >= least) & (n <= most) & (n / box >= fill))[own]
    return out


def local_mean(lum: np.ndarray, radius: int) -> np.ndarray:
    h, w = lum.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = lum.astype(np.float64).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius, h - 1) + 1
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius, w - 1) + 1
    return (s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]) / ((y1 - y0)[:, None] * (x1 - x0)[None])


def dark_marks(lum: np.ndarray, focus: np.ndarray | None = None, delta: float = 13, radius: int = 24, least: float = 24, most: float | None = None) -> np.ndarray:
    dark = lum < local_mean(lum, radius) - delta
    if focus is not None:
        dark &= focus > 128
    return compact_components(dark, least, 0.004 * lum.size if most is None else most)


def disc(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


def dilate_disc(mask: np.ndarray, radius: int) -> np.ndarray:
    if radius <= 0:
        return mask
    out = np.zeros(mask.shape, bool)
    for dx, dy in disc(radius):
        out |= shifted(mask, dx, dy, False)
    return out


def erode_disc(conf: np.ndarray, radius: int) -> np.ndarray:
    """255 where no pixel of at most 128 is within the disc, else 0. The frame does not erode."""
    return np.where(dilate_disc(conf <= 128, radius), 0, 255)
