"""Edge-preserving smoothing of float images as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regions as R
from .stencil import around


def _square(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def _apart(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def bilateral(px: DataFrame, columns: list[str], range_sigma: float, radius: int = 4) -> DataFrame:
    """(img, i, x, y, columns as floats) after one pass: the mean of the (2 radius + 1) squared window around each pixel, weighted by
    closeness in place (sigma radius / 1.5, stored as a float) and in value. Windows are cut off at the borders."""
    px = px.select("img", "i", "x", "y", *(F.col(c).cast("double").alias(c) for c in columns))
    sigma, side = radius / 1.5, 2 * radius + 1
    place = F.array(*(F.exp(F.lit(-(dx * dx + dy * dy) / (2 * sigma * sigma))).cast("float").cast("double") for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)))

    def mean(p: Column, taps: Column) -> Column:
        def weighed(t: Column) -> Column:
            q = t["q"]
            near = F.element_at(F.col("_place"), (t["dy"] + radius) * side + q["x"] - p["x"] + radius + 1)
            return F.struct((near * F.exp(-_apart([q[c] for c in columns], [p[c] for c in columns]) / (2 * range_sigma**2))).alias("w"), *(q[c].alias(c) for c in columns))

        none = F.struct(F.lit(0.0).alias("w"), *(F.lit(0.0).alias(c) for c in columns))
        add = lambda a, t: F.struct((a["w"] + t["w"]).alias("w"), *((a[c] + t["w"] * t[c]).alias(c) for c in columns))
        return F.aggregate(F.transform(taps, weighed), none, add, lambda a: F.struct(*((a[c] / a["w"]).cast("float").alias(c) for c in columns)))

    return around(px, columns, radius, mean, {"_place": place}).select("img", "i", "x", "y", *(F.col(f"v.{c}").alias(c) for c in columns))


def guided_upsample(low: DataFrame, px: DataFrame, columns: list[str], size: tuple[int, int], small: tuple[int, int], range_sigma: float, window: int = 2, frames: DataFrame | None = None) -> DataFrame:
    """(img, i, columns as floats): a value for each pixel of the guide ``px``, the mean of the samples (img, ox, oy, columns) of the shrunk
    image around its place, weighted by distance in place (sigma window / 1.5 samples) and by their difference from the guide; the
    nearest sample if all weights vanish. Images are ``size[0]`` wide and reach down to their last row (``frames``, if it is known).

    The samples' rows within ``window`` of a row form a band of arrays. A pixel is shuffled once, to the band that it falls into; its taps are cut out of that band and added up in the
    same task, so none of them is shuffled."""
    guide = px.join((R.frames(px) if frames is None else frames).select("img", (F.col("bottom") + 1).alias("_h")), "img")
    at = [(F.col(c) + 0.5) * (m / n) - 0.5 for c, n, m in (("x", F.lit(float(size[0])), F.lit(float(small[0]))), ("y", F.col("_h").cast("double"), F.lit(float(small[1]))))]
    base = [F.least(F.lit(m - 1), F.greatest(F.lit(0), F.floor(c + 0.5))).cast("int") for c, m in zip(at, small, strict=True)]
    guide = guide.select("img", "i", "x", "y", "_h", *columns, base[1].alias("by")).join(_bands(low, columns, small, window), ["img", "by"])
    guide = guide.select("img", "by", "i", "near", *(F.col(c).cast("double").alias(c) for c in columns), at[0].alias("cx"), at[1].alias("cy"), base[0].alias("bx"))
    o = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _square(window))))
    taps = guide.withColumn("o", o).withColumns({"ox": F.col("bx") + F.col("o.dx"), "oy": F.col("by") + F.col("o.dy")})
    tap = lambda c: F.get(F.get("near", F.col("o.dy") + window)[c], F.col("ox"))
    met = taps.where(tap("ox").isNotNull()).select("img", "by", "i", "cx", "cy", "bx", "ox", "oy", *columns, *(tap(c).cast("double").alias(f"n_{c}") for c in columns))
    sigma = window / 1.5
    dy, dx = F.col("oy") - F.col("cy"), F.col("ox") - F.col("cx")
    w = F.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma)) * F.exp(-_apart([F.col(f"n_{c}") for c in columns], [F.col(c) for c in columns]) / (2 * range_sigma**2))
    met = met.withColumns({"w": w, "own": (F.col("ox") == F.col("bx")) & (F.col("oy") == F.col("by"))})
    total = F.sum("w")
    mean = lambda c: F.when(total > 1e-12, F.sum(F.col("w") * F.col(f"n_{c}")) / total).otherwise(F.max(F.when(F.col("own"), F.col(f"n_{c}"))))
    return met.groupBy("img", "by", "i").agg(*(mean(c).cast("float").alias(c) for c in columns)).select("img", "i", *columns)


def _bands(low: DataFrame, columns: list[str], small: tuple[int, int], window: int) -> DataFrame:
    """(img, by, near) for each row of a shrunk image: the rows within ``window`` of it, from top to bottom, each a struct of arrays of ox and ``columns`` (floats) by ox. Rows and samples that
    are not there are null."""
    row = F.array_sort(F.collect_list(F.struct("ox", *(F.col(c).cast("float").alias(c) for c in columns))))
    each = F.sequence(F.lit(0), F.lit(small[0] - 1))
    whole = F.when(F.size("row") == small[0], F.col("row")).otherwise(F.transform(each, lambda x: F.get(F.filter("row", lambda e: e["ox"] == x), F.lit(0))))
    rows = low.groupBy("img", "oy").agg(row.alias("row")).select("img", "oy", whole.alias("row"))
    by = F.explode(F.sequence(F.greatest(F.lit(0), F.col("oy") - window), F.least(F.lit(small[1] - 1), F.col("oy") + window)))
    met = rows.select("img", by.alias("by"), F.struct("oy", *(F.col(f"row.{c}").alias(c) for c in ("ox", *columns))).alias("r")).groupBy("img", "by").agg(F.collect_list("r").alias("near"))
    return met.withColumn("near", F.transform(F.sequence(F.col("by") - window, F.col("by") + window), lambda y: F.get(F.filter("near", lambda r: r["oy"] == y), F.lit(0))))
