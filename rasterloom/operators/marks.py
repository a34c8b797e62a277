"""Connected marks of sparse masks as relations: hysteresis, chains, compact components, brush strokes and box means.

A mask is a table of its set pixels (img, i, x, y). Components come from ``regions.grow``; what is kept follows from aggregates by
image and component, so neither an image nor a component has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import regions as R


def _rooted(mask: DataFrame) -> DataFrame:
    """The mask's rows with the root of their 8-connected component."""
    return mask.join(R.grow(mask.withColumn("_v", F.lit(1)), "_v", eight=True), ["img", "i"])


def _kept(rooted: DataFrame, stats: list[Column], where: Column) -> DataFrame:
    good = rooted.groupBy("img", "root").agg(*stats).where(where).select("img", "root")
    return rooted.join(good, ["img", "root"], "left_semi").select("img", "i", "x", "y")


def hysteresis(px: DataFrame, weak: Column, strong: Column) -> DataFrame:
    """Pixels of the components of ``weak`` or ``strong`` that hold a strong one."""
    either = px.where(weak | strong).select("img", "i", "x", "y", strong.alias("_strong"))
    return _kept(_rooted(either), [F.max("_strong").alias("s")], F.col("s"))


def long_chains(mask: DataFrame, least: int) -> DataFrame:
    """Components of at least ``least`` pixels."""
    return _kept(_rooted(mask.select("img", "i", "x", "y")), [F.count(F.lit(1)).alias("n")], F.col("n") >= least)


def compact(mask: DataFrame, least: float, most: DataFrame | float, fill: float = 0.3) -> DataFrame:
    """Components of ``least`` to ``most`` pixels (one number, or (img, most)) that fill at least ``fill`` of their bounding box."""
    side = lambda c: F.max(c) - F.min(c) + 1
    bound = F.lit(most) if not isinstance(most, DataFrame) else F.col("_most")
    rooted = _rooted(mask.select("img", "i", "x", "y"))
    stats = [F.count(F.lit(1)).alias("n"), (side("x") * side("y")).alias("box")]
    if isinstance(most, DataFrame):
        rooted = rooted.join(most.select("img", F.col("most").alias("_most")), "img")
        stats.append(F.max("_most").alias("_most"))
    return _kept(rooted, stats, (F.col("n") >= least) & (F.col("n") <= bound) & (F.col("n") / F.col("box") >= fill))


def box_means(px: DataFrame, columns: list[str], width: int, to: tuple[int, int], frames: DataFrame | None = None) -> DataFrame:
    """(img, ox, oy and the means of ``columns``) over the boxes of a raster shrunk to ``to``; boxes have floor and ceiling bounds and may
    overlap. Images are ``width`` wide and reach down to their last row (``frames``, if it is known)."""

    def span(df: DataFrame, c: str, n: Column, m: int, name: str, keep: list[str]) -> DataFrame:
        """A row for each box that holds a place: the boxes around it are looked at, all others are too far away."""
        place = lambda k: F.floor((F.col(c) + k) * m / n).cast("int")
        near = df.select(*keep, c, n.alias("_n"), F.explode(F.sequence(F.greatest(F.lit(0), place(0) - 1), F.least(F.lit(m - 1), place(1) + 1))).alias(name))
        o, n = F.col(name), F.col("_n")
        return near.where(o.between(0, m - 1) & (F.floor(o * n / F.lit(float(m))) <= F.col(c)) & (F.ceil((o + 1) * n / F.lit(float(m))) > F.col(c))).select(*keep, name)

    tall = px.join((R.frames(px) if frames is None else frames).select("img", (F.col("bottom") + 1).alias("_h")), "img")
    wide = span(tall, "x", F.lit(width), to[0], "ox", ["img", "y", "_h", *columns])
    both = span(wide, "y", F.col("_h"), to[1], "oy", ["img", "ox", *columns])
    return both.groupBy("img", "ox", "oy").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))


def strokes(points: DataFrame, radius: int, frame: DataFrame, by: tuple[str, ...] = ("img",), order: str = "i") -> DataFrame:
    """(img, x, y) under a round brush along the closed line through the points (x, y) of each ``by`` (img first), in ``order``."""
    w = Window.partitionBy(*by).orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.coalesce(F.lead(c).over(w), F.first(c).over(every)).alias(f"{c}1") for c in "xy"]
    line = points.select("img", "x", "y", *ends).withColumns({"dx": F.col("x1") - F.col("x"), "dy": F.col("y1") - F.col("y")})
    steps = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))).cast("int"))
    along = line.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = [F.floor(F.col(c) + F.col(f"d{c}") * (F.col("k") / F.col("n")) + 0.5).cast("int").alias(c) for c in "xy"]
    return R.dilate(along.select("img", *at).distinct(), radius, frame)
