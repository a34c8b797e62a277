"""Region relations: adjacency, statistics, numbering, run-length maps, outlines and fills, as joins, windows and aggregates.

All windows and joins are keyed by image (and row or column), so they spread over images and never meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import cut
from .stencil import around


def row_window():
    """Pixels of a row, from left to right."""
    return Window.partitionBy("img", "y").orderBy("x")


def col_window():
    """Pixels of a column, from top to bottom."""
    return Window.partitionBy("img", "x").orderBy("y")


def neighbours(df: DataFrame, col: str) -> DataFrame:
    """Adds _e, _w, _s, _n: the value of the four neighbours, null outside. Pixels of a row and column must be complete."""
    return df.withColumns({"_e": F.lead(col).over(row_window()), "_w": F.lag(col).over(row_window()), "_s": F.lead(col).over(col_window()), "_n": F.lag(col).over(col_window())})


def adjacency(df: DataFrame, col: str) -> DataFrame:
    """(img, a, b, border): length of the border between two labels, both ways."""
    near = neighbours(df, col)
    pairs = near.select("img", F.col(col).alias("a"), F.explode(F.array("_e", "_s")).alias("b")).where("b is not null and a <> b")
    half = pairs.groupBy("img", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return half.union(half.select("img", F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("img", "a", "b").agg(F.sum("n").alias("border"))


def boundary(df: DataFrame, col: str, both_sides: bool = True) -> Column:
    """Whether a pixel differs from a neighbour: from any of four, or only from those to the right and below."""
    return F.greatest(*(F.coalesce(F.col(c) != F.col(col), F.lit(False)) for c in (("_e", "_w", "_s", "_n") if both_sides else ("_e", "_s"))))


def runs(df: DataFrame, col: str) -> DataFrame:
    """(img, run_no from 0, value, start_i, len): runs of equal values in raster order; runs may go on over rows."""
    w = Window.partitionBy("img").orderBy("i")
    start = df.withColumn("s", F.coalesce((F.lag(col).over(w) != F.col(col)).cast("int"), F.lit(0))).withColumn("run_no", F.sum("s").over(w))
    return start.groupBy("img", "run_no").agg(F.first(col).alias("value"), F.min("i").alias("start_i"), F.count(F.lit(1)).alias("len"))


def encode_runs(df: DataFrame, col: str) -> DataFrame:
    """(img, runs): alternating value and length, as one array for each image."""
    r = runs(df, col)
    packed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "value", "len"))), lambda s: F.array(s["value"].cast("bigint"), s["len"])))
    return r.groupBy("img").agg(packed.alias("runs"))


def decode_runs(encoded: DataFrame) -> DataFrame:
    """(img, i, value) from (img, runs)."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda k: F.struct(F.get("runs", (2 * k).cast("int")).alias("value"), F.get("runs", (2 * k + 1).cast("int")).alias("len")))
    flat = encoded.where(F.size("runs") > 0).select("img", F.posexplode(pairs).alias("no", "p")).select("img", "no", "p.*")
    begin = F.sum("len").over(Window.partitionBy("img").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")
    return flat.withColumn("begin", begin).select("img", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("len") - 1)).alias("i"), "value")


def color_numbers(regions: DataFrame) -> DataFrame:
    """(img, color, color_no): colours by total area, largest first; ties go to the colour of the earliest region.
    ``regions``: (img, region_id, color, area)."""
    total = regions.groupBy("img", "color").agg(F.sum("area").alias("area"), F.min("region_id").alias("first"))
    return total.select("img", "color", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("area"), "first")).alias("color_no"))


def renumber(df: DataFrame, col: str) -> DataFrame:
    """(img, old, id): labels as 1, 2, ... in raster order of first appearance."""
    first = df.groupBy("img", F.col(col).alias("old")).agg(F.min("i").alias("first"))
    return first.select("img", "old", F.row_number().over(Window.partitionBy("img").orderBy("first")).alias("id"))


def label_points(df: DataFrame, col: str) -> DataFrame:
    """(img, region_id, label_x, label_y): the member nearest to the rounded centroid, by growing squares and, within a square, row by
    row."""
    c = df.groupBy("img", col).agg(F.floor(F.avg("x") + 0.5).alias("cx"), F.floor(F.avg("y") + 0.5).alias("cy"))
    ring = F.greatest(F.abs(F.col("x") - F.col("cx")), F.abs(F.col("y") - F.col("cy")))
    best = df.join(c, ["img", col]).groupBy("img", col).agg(F.min(F.struct(ring.alias("ring"), "y", "x")).alias("m"))
    return best.select("img", F.col(col).alias("region_id"), F.col("m.x").alias("label_x"), F.col("m.y").alias("label_y"))


def frames(df: DataFrame) -> DataFrame:
    """(img, right, bottom): the last column and row of each image."""
    return df.groupBy("img").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))


def at_offsets(df: DataFrame, offsets: list[tuple[int, int]], frame: DataFrame, keep: list[str]) -> DataFrame:
    """Each pixel sent to the places (x + dx, y + dy) inside its image's ``frame``, as nx, ny with its ``keep`` columns and dx, dy."""
    o = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets)))
    moved = df.join(frame, "img").select("img", "x", "y", "right", "bottom", *keep, o.alias("o"))
    moved = moved.select("img", "right", "bottom", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"), "o.dx", "o.dy", *keep)
    return moved.where("nx between 0 and right and ny between 0 and bottom").drop("right", "bottom")


def dilate(mask: DataFrame, radius: int, frame: DataFrame) -> DataFrame:
    """(img, x, y) within a disc of a set pixel of the sparse mask (img, x, y). A radius of 0 or less changes nothing."""
    if radius <= 0:
        return mask.select("img", "x", "y")
    disc = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    return at_offsets(mask, disc, frame, []).select("img", F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()


def with_local_mean(df: DataFrame, col: str, radius: int) -> DataFrame:
    """Adds mean: the average over the (2 radius + 1) squared window, cut off at the borders, by row sums and then column sums."""
    r, c = row_window().rowsBetween(-radius, radius), col_window().rowsBetween(-radius, radius)
    part = df.withColumns({"_s": F.sum(col).over(r), "_k": F.count(col).over(r)})
    return part.withColumn("mean", F.sum("_s").over(c) / F.sum("_k").over(c)).drop("_s", "_k")


def vote(df: DataFrame, col: str, radius: int) -> DataFrame:
    """(img, x, y, value): one majority pass; ties go to the present value, then the lowest."""

    def most(p: Column, taps: Column) -> Column:
        seen = F.transform(taps, lambda t: t["q"][col])
        count = lambda v: F.size(F.filter(seen, lambda s: s == v))
        return F.array_max(F.transform(F.array_distinct(seen), lambda v: F.struct(count(v).alias("c"), (v == p[col]).alias("own"), (-v).alias("low"), v.alias("v"))))["v"]

    return around(df, [col], radius, most).select("img", "x", "y", F.col("v").alias("value"))


def grow(df: DataFrame, col: str, eight: bool = False) -> DataFrame:
    """(img, i, root): smallest pixel id of each pixel's component of equal values; null values belong to none.

    Runs of equal pixels in a row are found by a window and are the nodes from then on, so that rounds go over runs and not pixels; each run is named by its first pixel, and
    linked to the runs that its pixels touch in the row above. Rounds take the least label among the neighbours, then that label's own
    label, each written by checkpoint() to the session's checkpoint folder."""
    px = df.where(F.col(col).isNotNull()).select("img", "i", "x", "y", F.col(col).alias("v"))
    before = F.lag(F.struct("x", "v")).over(row_window())
    begins = before.isNull() | (before["x"] != F.col("x") - 1) | (before["v"] != F.col("v"))
    runs_of = px.withColumn("begin", F.when(begins, F.col("i")))
    runs_of = cut(runs_of.withColumn("run", F.max("begin").over(row_window().rowsBetween(Window.unboundedPreceding, 0))).drop("begin"))
    lines = [F.col("x"), *([F.col("x") - F.col("y"), F.col("x") + F.col("y")] if eight else [])]  # columns, and both diagonals
    pairs = []
    for line in lines:
        above = F.lag(F.struct("y", "v", "run")).over(Window.partitionBy("img", "line").orderBy("y"))
        near = runs_of.withColumn("line", line).withColumn("up", above).where((F.col("up.y") == F.col("y") - 1) & (F.col("up.v") == F.col("v")))
        pairs.append(near.select("img", F.col("run").alias("a"), F.col("up.run").alias("b")))
    edge = reduce(DataFrame.union, pairs).distinct()
    edge = cut(edge.union(edge.select("img", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(runs_of.where("i = run").select("img", "i", F.col("i").alias("root")))
    while True:
        seen = edge.join(label.select("img", F.col("i").alias("b"), "root"), ["img", "b"]).groupBy("img", F.col("a").alias("i")).agg(F.min("root").alias("m"))
        step = label.join(seen, ["img", "i"], "left").select("img", "i", "root", F.least("root", F.coalesce("m", "root")).alias("new"))
        top = step.select("img", F.col("i").alias("new"), F.col("new").alias("jump"))
        hook = step.groupBy("img", F.col("root").alias("i")).agg(F.min("new").alias("h"))
        nxt = cut(step.join(top, ["img", "new"], "left").join(hook, ["img", "i"], "left").select("img", "i", "root", F.least("jump", F.coalesce("h", "jump")).alias("new")))
        if not nxt.where("root <> new").limit(1).count():
            break
        label = nxt.select("img", "i", F.col("new").alias("root"))
    return runs_of.select("img", "i", "run").join(nxt.select("img", F.col("i").alias("run"), "root"), ["img", "run"]).select("img", "i", "root")
