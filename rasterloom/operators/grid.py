"""Operators that run image by image with NumPy: stencils, components, palettes.

``per_image`` is the one grouped-map: an image is a group, bounded by its size in pixels (1536 x 1536 at most in the
reference's parameters), so memory is bounded, and images are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

AROUND_4 = ((-1, 0), (1, 0), (0, -1), (0, 1))
AROUND_8 = tuple((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy)


def per_image(pixels: DataFrame, size: tuple[int, int], columns: list[str], f: Callable[[dict], dict], schema: str) -> DataFrame:
    """f gets (rows, width) arrays of ``columns`` and ``valid`` (whether the pixel exists), down to the image's last row, and returns
    columns of rows; img is added. ``schema`` starts with img."""
    ship(pixels.sparkSession)
    width = size[0]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid: dict[str, np.ndarray] = {}
        at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
        height = int(at[0].max()) + 1
        grid["valid"] = np.zeros((height, width), bool)
        grid["valid"][at] = True
        for c in columns:
            v = pdf[c].to_numpy()
            grid[c] = np.zeros((height, width), v.dtype)
            grid[c][at] = v
        out = f(grid)
        return pd.DataFrame({"img": key[0], **out})

    return pixels.groupBy("img").applyInPandas(run, schema)


def rows_of(grids: dict[str, np.ndarray], where: np.ndarray) -> dict[str, np.ndarray]:
    """Columns i, x, y and those of ``grids`` for the pixels where ``where`` holds."""
    y, x = np.nonzero(where)
    return {"i": y * where.shape[1] + x, "x": x, "y": y} | {k: g[y, x] for k, g in grids.items()}


def shifted(a: np.ndarray, dx: int, dy: int, fill) -> np.ndarray:
    """b[y, x] = a[y + dy, x + dx], ``fill`` outside."""
    h, w = a.shape
    out = np.full_like(a, fill)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    yt, xt = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = a[yt, xt]
    return out


def components(value: np.ndarray, valid: np.ndarray, around=AROUND_4) -> np.ndarray:
    """Label of each pixel: the smallest pixel id of its component of equal values (-1 where not valid). Labels spread to
    neighbours and are then replaced by their own labels, until nothing changes."""
    h, w = value.shape
    label = np.where(valid, np.arange(h * w).reshape(h, w), h * w)
    same = [(dx, dy, shifted(valid, dx, dy, False) & valid & (shifted(value, dx, dy, value.dtype.type(0)) == value)) for dx, dy in around]
    while True:
        new = label.copy()
        for dx, dy, ok in same:
            near = shifted(label, dx, dy, h * w)
            new = np.where(ok, np.minimum(new, near), new)
        flat = np.append(new.ravel(), h * w)
        np.minimum.at(flat, label.ravel(), new.ravel())  # the pixel that names the old label learns the new one
        flat = flat[flat]
        new = flat[flat][:-1].reshape(h, w)
        if (new == label).all():
            return np.where(valid, label, -1)
        label = new


def dense_rank(label: np.ndarray) -> np.ndarray:
    """Labels as 0, 1, ... in the order of the smallest pixel; -1 stays."""
    names = np.unique(label[label >= 0])
    return np.where(label >= 0, np.searchsorted(names, label), -1)


def area_of(label: np.ndarray) -> np.ndarray:
    """The size of each pixel's component; 0 for label -1."""
    n = np.bincount(label[label >= 0].ravel(), minlength=label.size)
    return np.where(label >= 0, n[np.maximum(label, 0)], 0)


def spatial_kernel(radius: int, sigma: float) -> np.ndarray:
    d = np.arange(-radius, radius + 1)
    return np.exp(-(d[None] ** 2 + d[:, None] ** 2) / (2 * sigma * sigma)).astype(np.float32)


def bilateral(lab: np.ndarray, range_sigma: float, radius: int = 4, sigma: float | None = None) -> np.ndarray:
    """One edge-preserving pass over a (h, w, channels) float32 image: weights fall with distance in place and in colour; windows are
    cut off at the borders. The place sigma is radius / 1.5 by default."""
    kernel = spatial_kernel(radius, radius / 1.5 if sigma is None else sigma).astype(np.float64)
    src = lab.astype(np.float64)
    h, w, _ = src.shape
    total, weight = np.zeros_like(src), np.zeros((h, w))
    inside = np.ones((h, w), bool)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            near = np.stack([shifted(src[..., c], dx, dy, 0.0) for c in range(src.shape[2])], axis=2)
            k = kernel[dy + radius, dx + radius] * np.exp(-((near - src) ** 2).sum(2) / (2 * range_sigma**2)) * shifted(inside, dx, dy, False)
            total += k[..., None] * near
            weight += k
    return (total / weight[..., None]).astype(np.float32)


def mode_filter(index: np.ndarray, radius: int, passes: int = 2, foreground: np.ndarray | None = None, foreground_values: int = 0) -> np.ndarray:
    """Majority of the (2 radius + 1) squared window, cut off at the borders; ties go to the present value, then the lowest. With
    ``foreground``, a pixel takes only values of its own part (below ``foreground_values`` or from there on)."""
    if radius <= 0 or passes <= 0:
        return index
    h, w = index.shape
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius, h - 1) + 1
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius, w - 1) + 1
    current = index.copy()
    for _ in range(passes):
        best = current.copy()
        counts = {}
        for v in np.unique(current):
            s = np.zeros((h + 1, w + 1), np.int64)
            s[1:, 1:] = np.cumsum(np.cumsum(current == v, 0), 1)
            counts[v] = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
        top = np.zeros((h, w), np.int64)
        for v, c in counts.items():
            top = np.where(current == v, c, top)
        for v, c in sorted(counts.items()):
            wins = c > top
            if foreground is not None:
                wins &= foreground == (v < foreground_values)
            best, top = np.where(wins, v, best), np.where(wins, c, top)
        current = best
    return current


def downscale(lab: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over boxes with floor and ceiling bounds; boxes may overlap."""
    h, w, _ = lab.shape
    out = np.empty((height, width, lab.shape[2]), np.float32)
    for oy in range(height):
        rows = lab[int(np.floor(oy * h / height)) : min(h, int(np.ceil((oy + 1) * h / height)))].astype(np.float64)
        for ox in range(width):
            out[oy, ox] = rows[:, int(np.floor(ox * w / width)) : min(w, int(np.ceil((ox + 1) * w / width)))].mean((0, 1))
    return out


def upsample(low: np.ndarray, guide: np.ndarray, range_sigma: float, window: int = 2) -> np.ndarray:
    """Restores the guide's size: each pixel averages the low-resolution samples around its place, weighted by distance in place
    (sigma window / 1.5 ... in low-resolution pixels) and by the guide's colour difference."""
    h, w, _ = guide.shape
    lh, lw, _ = low.shape
    sy, sx = lh / h, lw / w
    cy, cx = (np.arange(h) + 0.5) * sy - 0.5, (np.arange(w) + 0.5) * sx - 0.5
    by, bx = np.clip(np.floor(cy + 0.5).astype(int), 0, lh - 1), np.clip(np.floor(cx + 0.5).astype(int), 0, lw - 1)
    sigma = window / 1.5
    total, weight = np.zeros(guide.shape), np.zeros((h, w))
    g, src = guide.astype(np.float64), low.astype(np.float64)
    for dy in range(-window, window + 1):
        for dx in range(-window, window + 1):
            ny, nx = by + dy, bx + dx
            ok = ((ny >= 0) & (ny < lh))[:, None] & ((nx >= 0) & (nx < lw))[None]
            tap = src[np.clip(ny, 0, lh - 1)][:, np.clip(nx, 0, lw - 1)]
            place = ((ny - cy) ** 2)[:, None] + ((nx - cx) ** 2)[None]
            k = np.exp(-place / (2 * sigma * sigma)) * np.exp(-((tap - g) ** 2).sum(2) / (2 * range_sigma**2)) * ok
            total += k[..., None] * tap
            weight += k
    nearest = src[by][:, bx]
    return np.where((weight > 1e-12)[..., None], total / np.maximum(weight, 1e-300)[..., None], nearest).astype(np.float32)


def smooth(lab: np.ndarray, iterations: int, range_sigma: float, cap: int = 640) -> np.ndarray:
    """Repeated bilateral passes, at ``cap`` pixels on the longer edge at most, then guided upsampling."""
    h, w, _ = lab.shape
    out = lab
    if max(h, w) > cap:
        s = cap / max(h, w)
        out = downscale(lab, max(1, int(np.floor(w * s + 0.5))), max(1, int(np.floor(h * s + 0.5))))
    for _ in range(iterations):
        out = bilateral(out, range_sigma)
    return out if out.shape == lab.shape else upsample(out, lab, range_sigma)
