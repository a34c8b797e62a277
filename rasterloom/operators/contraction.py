"""Merging small and similar regions by contraction of the region graphs of all images at once, as relations.

The rules (see ``merge.py``, which holds them for one image in a task) depend on an order: small regions go one after the other. But a region's choice depends only on its neighbours and
their areas, and a merge changes only what is next to it. So in a round all regions of all images' queues go that have no earlier one within two steps in
the graph (three, where either side of a pair may go); they can't meet, and the outcome is that of the queue gone through in order. Regions and links are relations, a round is
some joins and aggregates, cut off by tables written to the shared folder. Which region went into which is a forest that is resolved
at the end by pointer doubling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import light
from ..shipping import stored as cut
from . import regions as R
from .merge import AREA, BORDER, CROSSING, NEAR_TIE

#: Places of one turn through the queue lie below those of the next.
TURN = 1 << 32


def region_graph(px: DataFrame, label: str, color: str) -> tuple[DataFrame, DataFrame]:
    """Regions (img, id, area, color, place) and links (img, a, b, n, t, k) of a complete raster of labels: n is the length of the border, place and (t, k) tell in which order the raster scan
    meets regions and neighbours, looking from each pixel to the right and then down."""
    near = R.neighbours(px.withColumn("_l", F.col(label)), "_l")
    sides = F.explode(F.array(F.struct(F.col("_e").alias("b"), F.lit(0).alias("s")), F.struct(F.col("_s").alias("b"), F.lit(1).alias("s")))).alias("o")
    edge = near.select("img", F.col("_l").alias("a"), "i", sides).where("o.b <> a").select("img", "a", "o.b", (F.col("i") * 2 + F.col("o.s")).alias("k"))
    half = cut(edge.groupBy("img", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k")))
    both = half.union(half.select("img", F.col("b").alias("a"), F.col("a").alias("b"), "n", "k")).groupBy("img", "a", "b").agg(F.sum("n").alias("n"), F.min("k").alias("k"))
    links = cut(both.select("img", "a", "b", "n", F.lit(0).cast("bigint").alias("t"), "k"))
    met = half.select("img", F.explode(F.array(F.struct(F.col("a").alias("id"), (F.col("k") * 2).alias("p")), F.struct(F.col("b").alias("id"), (F.col("k") * 2 + 1).alias("p")))).alias("m")).groupBy("img", "m.id").agg(F.min("m.p").alias("place"))
    stats = px.groupBy("img", F.col(label).alias("id")).agg(F.count(F.lit(1)).alias("area"), F.min_by(color, "i").alias("color"))
    return cut(stats.join(met, ["img", "id"], "left")), links


def color_bands(palette: list, foreground: int | None = None) -> Column:
    """The band of two colours (columns ca, cb): how many steps their colours are apart, ``CROSSING`` more across the parts; a look-up by index."""
    n = len(palette)
    apart = [[sum((float(x) - float(y)) ** 2 for x, y in zip(palette[i], palette[j], strict=True)) for j in range(n)] for i in range(n)]
    band = [[int(apart[i][j] ** 0.5 // NEAR_TIE) + CROSSING * (foreground is not None and (i < foreground) != (j < foreground)) for j in range(n)] for i in range(n)]
    return F.element_at(F.array(*(F.lit(v) for row in band for v in row)), (F.col("ca") * n + F.col("cb") + 1).cast("int"))


def alike(palette: list, delta: float) -> Column:
    """Whether two colours (columns ca, cb) are less than ``delta`` apart."""
    n = len(palette)
    near = [sum((float(x) - float(y)) ** 2 for x, y in zip(a, b, strict=True)) < delta**2 for a in palette for b in palette]
    return F.element_at(F.array(*(F.lit(v) for v in near)), (F.col("ca") * n + F.col("cb") + 1).cast("int"))


def _first_around(queue: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """The entries (img, id, pos) of the queue with none before them within ``hops`` steps."""
    v = queue.select("img", "id", F.col("pos").alias("m"))
    for _ in range(hops):
        v = v.union(links.join(v.select("img", F.col("id").alias("b"), "m"), ["img", "b"]).select("img", F.col("a").alias("id"), "m")).groupBy("img", "id").agg(F.min("m").alias("m"))
    return queue.join(v, ["img", "id"]).where("pos = m").drop("m")


def _sides(links: DataFrame, regions: DataFrame) -> DataFrame:
    """Links with what both regions are (suffixes a and b)."""
    regions = light(regions)
    of = lambda s: regions.select("img", F.col("id").alias(s), F.col("area").alias(f"area_{s}"), F.col("color").alias(f"c{s}"), F.col("back").alias(f"back_{s}"))
    return links.join(of("a"), ["img", "a"], "left").join(of("b"), ["img", "b"], "left")


def _contract(regions: DataFrame, links: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and links after ``merges`` (img, gone, into, pos), no two of which are next to one another. The survivor keeps its colour; borders to common neighbours add up; new neighbours come
    after older ones, in the order in which the region that is gone had them."""
    gone = merges.select("img", F.col("gone").alias("id"))
    more = merges.join(regions.select("img", F.col("id").alias("gone"), F.col("area").alias("more")), ["img", "gone"]).select("img", F.col("into").alias("id"), "more")
    kept = regions.join(gone, ["img", "id"], "left_anti").join(more, ["img", "id"], "left").withColumn("area", F.col("area") + F.coalesce("more", F.lit(0))).drop("more")
    stay = links.join(gone.withColumnRenamed("id", "a"), ["img", "a"], "left_anti").join(gone.withColumnRenamed("id", "b"), ["img", "b"], "left_anti").select("img", "a", "b", "n", "t", "k")
    lost = links.join(merges.select("img", F.col("gone").alias("a"), "into", "pos"), ["img", "a"])
    rank = F.row_number().over(Window.partitionBy("img", "a").orderBy("t", "k")).cast("bigint")
    moved = lost.withColumn("r", rank).where("b <> into").select("img", "into", "b", "n", F.col("pos").alias("t"), F.col("r").alias("k"))
    both = moved.union(moved.select("img", "b", "into", "n", "t", "k")).toDF("img", "a", "b", "n", "t", "k")
    every = stay.union(both).groupBy("img", "a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("t", "k")).alias("o"))
    return cut(kept), cut(every.select("img", "a", "b", "n", "o.t", "o.k"))


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _swallow_small(regions: DataFrame, links: DataFrame, band: Column, merges: list) -> tuple[DataFrame, DataFrame]:
    """Regions below their ``least`` join their best neighbours, turn by turn, in the order in which they became small.

    The queue holds this turn's entries (``now``) and those of the next one, whose places are those of the merges that put them there until their turn begins."""
    small = F.col("area") < F.col("least")
    queue = cut(regions.where(small).select("img", "id", (F.col("id") + TURN).alias("pos"), F.lit(True).alias("now")))
    while _some(queue):
        held = light(queue)
        ready = _first_around(held.where("now").select("img", "id", "pos"), links, 2)
        option = _sides(links.join(ready.select("img", F.col("id").alias("a"), "pos"), ["img", "a"], "right"), regions)
        weight = -(F.col("n") * BORDER + F.col("area_b") * AREA - F.col("b"))
        best = option.groupBy("img", "a", "pos").agg(F.min(F.when(F.col("b").isNotNull(), F.struct(band.alias("band"), weight.alias("w"), "t", "k", "b"))).alias("m"))
        turned = cut(best.select("img", F.col("a").alias("gone"), F.col("m.b").alias("into"), "pos"))
        done = turned.where("into is not null")
        merges.append(done)
        regions, links = _contract(regions, links, light(done))
        gone = light(turned.select("img", F.col("gone").alias("id")))
        still = light(regions.where(small).select("img", "id"))
        left = held.join(gone, ["img", "id"], "left_anti")
        again = done.select("img", F.col("into").alias("id"), "pos").join(left.where("now").select("img", "id"), ["img", "id"], "left_anti").withColumn("now", F.lit(False))
        every = left.union(again).groupBy("img", "id", "now").agg(F.min("pos").alias("pos")).join(still, ["img", "id"], "left_semi")
        # images that have no entry left of this turn go on to the next one
        whole = Window.partitionBy("img")
        turn = F.floor(F.max("pos").over(whole) / TURN) + 1
        place = turn * TURN + F.row_number().over(whole.orderBy("now", "pos"))
        busy = F.max("now").over(whole)
        queue = cut(every.withColumns({"busy": busy, "place": place}).select("img", "id", F.when(F.col("busy"), F.col("pos")).otherwise(F.col("place")).alias("pos"), (F.col("now") | ~F.col("busy")).alias("now")))
    return regions, links


def _collapse_background(regions: DataFrame, links: DataFrame, like: Column, merges: list, start: int) -> tuple[DataFrame, DataFrame]:
    """Background regions sweep over their neighbours in the order of the raster; of a region and the first of its neighbours that is background and alike, the smaller
    one joins the larger. Images in which something moved sweep again."""
    sweep, images = start, regions.select("img").distinct()
    while True:
        queue = cut(regions.where("back and place is not null").join(images, "img", "left_semi").select("img", "id", (F.col("place") + sweep * TURN).alias("pos")))
        moved: list[DataFrame] = []
        while _some(queue):
            ready = light(cut(_first_around(light(queue), links, 3)))
            option = _sides(links.join(ready.select("img", F.col("id").alias("a"), "pos"), ["img", "a"]), regions).where(F.col("back_b") & like)
            first = option.groupBy("img", "a", "pos", "area_a").agg(F.min(F.struct("t", "k", "b", "area_b")).alias("m"))
            larger = F.col("area_a") >= F.col("m.area_b")
            done = cut(first.select("img", F.when(larger, F.col("m.b")).otherwise(F.col("a")).alias("gone"), F.when(larger, F.col("a")).otherwise(F.col("m.b")).alias("into"), "pos"))
            left = queue.join(ready.select("img", "id"), ["img", "id"], "left_anti")
            if _some(done):
                moved.append(done)
                regions, links = _contract(regions, links, light(done))
                left = left.join(done.select("img", F.col("gone").alias("id")), ["img", "id"], "left_anti")
            queue = cut(left)
        if not moved:
            return regions, links
        merges += moved
        images, sweep = cut(reduce(DataFrame.union, moved).select("img").distinct()), sweep + 1


def resolved(regions: DataFrame, merges: list) -> DataFrame:
    """(img, id, root): the region that each region is part of in the end, by pointer doubling over who went into whom."""
    to = reduce(DataFrame.union, [m.select("img", F.col("gone").alias("id"), F.col("into").alias("root")) for m in merges]) if merges else regions.where("false").select("img", "id", F.col("id").alias("root"))
    name = cut(regions.select("img", "id").join(to, ["img", "id"], "left").select("img", "id", F.coalesce("root", "id").alias("root")))
    while True:
        jump = name.select("img", F.col("id").alias("root"), F.col("root").alias("far"))
        step = cut(name.join(jump, ["img", "root"]).select("img", "id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("new")))
        name = step.select("img", "id", "root")
        if not _some(step.where("new")):
            return name


def merged(regions: DataFrame, links: DataFrame, palette: list, delta: float | None = None, foreground: int | None = None) -> DataFrame:
    """(img, id, root) after small regions have joined their best neighbours and, with ``delta``, similar background regions one another. ``regions``: (img, id, area, color, place, least, back),
    ``links``: (img, a, b, n, t, k), see ``region_graph``; colours are indexes of ``palette``, those below ``foreground`` are foreground."""
    merges: list[DataFrame] = []
    now, near = _swallow_small(regions, links, color_bands(palette, foreground), merges)
    if delta:
        _collapse_background(now, near, alike(palette, delta), merges, 1 << 20)
    return resolved(regions, merges)
