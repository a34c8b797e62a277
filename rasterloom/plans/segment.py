"""Whole pipelines over images: segmentation and outlines. Each image is a group; images are spread over all tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import TO_RGB, TO_XYZ, WHITE
from ..functions.color import lab as lab_expr
from ..operators import borders, edges, marks
from ..operators import regions as R
from ..operators.grid import components, dense_rank, mode_filter, shifted, smooth
from ..operators.merge import RegionGraph, merge_regions
from ..operators.palette_grid import assign_grid, kmeans
from ..shipping import ship


@dataclass(frozen=True)
class Params:
    """One tier. Areas are (fraction of the pixels, least pixels)."""

    max_edge: int
    colors: int
    iterations: int
    range_sigma: float
    mode_radius: int
    min_area: tuple[float, int]
    background_area: tuple[float, int]
    background_delta: float
    regions: tuple[int, int] | None

    def areas(self, pixels: int) -> tuple[float, float]:
        return tuple(max(pixels * f, least) for f, least in (self.min_area, self.background_area))


# The four tiers.
TIERS = {
    "easy": Params(640, 8, 6, 14, 4, (0.004, 400), (0.012, 3000), 14, (12, 45)),
    "medium": Params(1024, 14, 5, 11, 3, (0.0015, 450), (0.008, 4500), 9, (30, 100)),
    "hard": Params(1536, 24, 4, 8, 2, (0.0005, 400), (0.005, 6000), 7, (65, 200)),
    "outline": Params(1024, 10, 7, 15, 4, (0.004, 1500), (0.04, 20000), 16, (6, 40)),
}
BOOST, FOREGROUND_SHARE, USABLE, ATTEMPTS = 1.12, 0.65, 0.02, 3
INK = 31


def budget(colors: int) -> tuple[int, int]:
    """Colours of the foreground and of the background."""
    fg = max(4, math.floor(colors * FOREGROUND_SHARE + 0.5))
    return fg, max(3, colors - fg)


@dataclass
class Segmentation:
    label: np.ndarray  # final region ids, 1-based, in raster order of first appearance
    palette: np.ndarray  # Lab of the centroids
    color: np.ndarray  # centroid of each region (index id - 1)


def _attempt(lab: np.ndarray, conf: np.ndarray | None, fg: np.ndarray | None, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if fg is None:
        palette, split = kmeans(lab.reshape(-1, 3), p["colors"]), None
        index = mode_filter(assign_grid(lab, palette), p["mode_radius"])
    else:
        a, b = budget(p["colors"])
        front, back = kmeans(lab[fg], a), kmeans(lab[~fg], b)
        palette, split = np.concatenate([front, back]), len(front)
        index = np.where(fg, assign_grid(lab, front), split + assign_grid(lab, back))
        index = mode_filter(index, p["mode_radius"], foreground=fg, foreground_values=split)
    label = dense_rank(components(index, np.ones(index.shape, bool)))
    graph = RegionGraph.of(label, index)
    confidence = None
    if conf is not None:
        confidence = np.bincount(label.ravel(), conf.ravel()) / np.bincount(label.ravel()) / 255
    roots = merge_regions(graph, p["min_area"], p["background_area"], confidence, palette, p["delta"], split)
    return label, roots, palette, np.array(graph.color)


def segment_grid(lab: np.ndarray, conf: np.ndarray | None, p: dict, regions: tuple[int, int] | None) -> Segmentation:
    """One smoothed Lab image. ``p``: colors, mode_radius, min_area, background_area and delta (or None). Up to three attempts aim at the
    range of region counts; the last one counts even if it misses."""
    fg = None
    if conf is not None:
        fg = conf > 128
        if not USABLE <= fg.mean() <= 1 - USABLE:
            fg = None
    out = _attempt(lab, conf, fg, p)
    for _ in range(ATTEMPTS - 1):
        if regions is None:
            break
        n = len(np.unique(out[1]))
        if n < regions[0]:
            p = p | {"colors": math.floor(p["colors"] * 1.5 + 0.5) + 2, "min_area": p["min_area"] * 0.5, "background_area": p["background_area"] and p["background_area"] * 0.5, "delta": p["delta"] and p["delta"] * 0.7}
        elif n > regions[1]:
            k = n / regions[1] * 1.2
            p = p | {"min_area": p["min_area"] * k, "background_area": p["background_area"] and p["background_area"] * k}
        else:
            break
        out = _attempt(lab, conf, fg, p)
    label, roots, palette, color = out
    root = roots[label]
    names, first = np.unique(root, return_index=True)
    order = names[np.argsort(first)]
    rank = np.zeros(len(roots), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return Segmentation(rank[root], palette, color[order])


def tier_params(tier: Params, pixels: int) -> dict:
    small, back = tier.areas(pixels)
    return {"colors": tier.colors, "mode_radius": tier.mode_radius, "min_area": small, "background_area": back, "delta": tier.background_delta}


def segment_labels(pixels: DataFrame, size: tuple[int, int], tier: str = "easy", **changes) -> DataFrame:
    """(img, i, x, y, region_id, l, a, b) of each pixel of (img, i, x, y, r, g, b[, conf]): the region and its palette colour."""
    ship(pixels.sparkSession)
    p = replace(TIERS[tier], **changes)
    width, height = size
    with_conf = "conf" in pixels.columns
    lab = pixels.select("img", "i", "x", "y", *(["conf"] if with_conf else []), lab_expr(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("img", "x", "y", *(["conf"] if with_conf else []), "c.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
        h = max(at[0].max() + 1, 1)  # the last image of a table may be shorter
        grid = np.zeros((h, width, 3), np.float32)
        grid[at] = pdf[["l", "a", "b"]].to_numpy(np.float32)
        conf = None
        if with_conf:
            conf = np.zeros((h, width))
            conf[at] = pdf["conf"].to_numpy()
        s = segment_grid(smooth(grid, p.iterations, p.range_sigma), conf, tier_params(p, h * width), p.regions)
        y, x = np.indices(s.label.shape)
        c = s.palette[s.color[s.label.ravel() - 1]]
        return pd.DataFrame({"img": key[0], "i": (y * width + x).ravel(), "x": x.ravel(), "y": y.ravel(), "region_id": s.label.ravel(), "color_idx": s.color[s.label.ravel() - 1], "l": c[:, 0], "a": c[:, 1], "b": c[:, 2]})

    return lab.groupBy("img").applyInPandas(run, "img bigint, i bigint, x int, y int, region_id bigint, color_idx int, l float, a float, b float")


def outline_pixels(pixels: DataFrame, size: tuple[int, int], line_art: bool = False) -> DataFrame:
    """Inked pixels (img, i, x, y, ink, alpha) of (img, i, x, y, r, g, b[, conf][, alpha]).

    With ``line_art``, the alpha column of an outside drawing is inked as it is and nothing else is computed. Otherwise the union of the
    subject's silhouette (a relation), feature lines, lines between regions of clearly different colour, and dark marks (image by image)."""
    if line_art:
        return pixels.where("alpha > 0").select("img", "i", "x", "y", F.lit(INK).alias("ink"), "alpha")
    ship(pixels.sparkSession)
    p, width = TIERS["outline"], size[0]
    with_conf = "conf" in pixels.columns
    lab = pixels.select("img", "x", "y", *(["conf"] if with_conf else []), lab_expr(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("img", "x", "y", *(["conf"] if with_conf else []), "c.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
        h = at[0].max() + 1
        grid = np.zeros((h, width, 3), np.float32)
        grid[at] = pdf[["l", "a", "b"]].to_numpy(np.float32)
        conf = None
        if with_conf:
            conf = np.zeros((h, width))
            conf[at] = pdf["conf"].to_numpy()
        s = segment_grid(smooth(grid, p.iterations, p.range_sigma), conf, tier_params(p, h * width), p.regions)
        subject = None
        if conf is not None:
            n = np.bincount(s.label.ravel())
            subject = np.bincount(s.label.ravel(), conf.ravel()) / np.maximum(n, 1) > 127
        ink = region_lines(s, subject)
        focus = None
        if conf is not None:
            focus = np.where(subject[s.label], edges.erode_disc(conf, 6), 0)
        lum = smooth(grid, 2, 8)[..., 0]
        ink |= edges.dilate_disc(edges.feature_lines(lum, focus), 1) | edges.dark_marks(lum, focus)
        y, x = np.nonzero(ink)
        return pd.DataFrame({"img": key[0], "i": y * width + x, "x": x, "y": y, "ink": INK, "alpha": 255})

    ink = lab.groupBy("img").applyInPandas(run, "img bigint, i bigint, x int, y int, ink int, alpha int")
    if not with_conf:
        return ink
    drawn = silhouette(pixels, width).select("img", "i", "x", "y", F.lit(INK).alias("ink"), F.lit(255).alias("alpha"))
    return ink.union(drawn).distinct()


def silhouette(px: DataFrame, width: int, least: int = 200, epsilon: float = 2.2, rounds: int = 2, radius: int = 3) -> DataFrame:
    """(img, i, x, y): a drawn outline of the subject of a confidence mask (conf over 128)."""
    mask = borders.full_frame(px.withColumn("_v", (F.col("conf") > 128).cast("int")), "_v", width)
    line = borders.corners_cut(borders.simplified(borders.outlines(mask, "_v", least), epsilon), rounds)
    ink = marks.strokes(line, radius, R.frames(px), ("img", "loop"), "k")
    return px.select("img", "i", "x", "y").join(ink, ["img", "x", "y"], "left_semi").select("img", "i", "x", "y")


def painted(palette: np.ndarray) -> np.ndarray:
    """Lab of the palette as it is painted: chroma raised, rounded to bytes and read again."""
    fy = (palette[:, 0].astype(np.float64) + 16) / 116
    f = np.stack([fy + palette[:, 1] * BOOST / 500, fy, fy - palette[:, 2] * BOOST / 200], 1)
    xyz = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * WHITE
    lin = xyz @ np.array(TO_RGB).T
    v = np.where(lin <= 0.0031308, lin * 12.92, 1.055 * np.power(np.maximum(lin, 0), 1 / 2.4) - 0.055)
    c = np.clip(np.floor(v * 255 + 0.5), 0, 255) / 255
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4).astype(np.float32).astype(np.float64)
    t = lin @ np.array(TO_XYZ).T / WHITE
    g = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * g[:, 1] - 16, 500 * (g[:, 0] - g[:, 1]), 200 * (g[:, 1] - g[:, 2])], 1)


def region_lines(s: Segmentation, subject: np.ndarray | None, delta: float = 18) -> np.ndarray:
    """Both pixels of each pair of neighbours in regions of the same side whose colours differ by at least ``delta``."""
    c = painted(s.palette)[s.color[s.label - 1]]
    out = np.zeros(s.label.shape, bool)
    for dx, dy in ((1, 0), (0, 1)):
        other = shifted(s.label, dx, dy, 0)
        ok = (other > 0) & (other != s.label)
        if subject is not None:
            ok &= subject[s.label] == subject[other]
        d = sum((c[..., k] - shifted(c[..., k], dx, dy, 0.0)) ** 2 for k in range(3))
        ok &= d >= delta * delta
        out |= ok | shifted(ok, -dx, -dy, False)
    return out
