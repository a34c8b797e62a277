"""Borders of regions as relations: loops and holes, border order by pointer doubling, simplification level by level, corner cutting.

Neither an image nor a loop has to fit a task. A border is a list of steps in which every (pixel, direction of arrival) names the next one; the places
along it come from joins of that table with itself, each of which doubles the length of the jumps. Simplification splits all open arcs of all loops in one
aggregate a round. Rounds end in tables written to the shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import stored as cut
from . import regions as R

# The eight neighbours, clockwise from the west.
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))
#: After a move in direction d, where the pixel looked at before it lies.
BEHIND = tuple(AROUND.index((AROUND[d - 1][0] - AROUND[d][0], AROUND[d - 1][1] - AROUND[d][1])) for d in range(8))
SHARP = 60


def full_frame(px: DataFrame, col: str, width: int | None = None, fill: int = 0) -> DataFrame:
    """(img, i, x, y, ``col``) of every place of each image's frame, ``width`` wide (or as far as its last column); ``fill`` where no pixel is."""
    right = F.max("x") + 1 if width is None else F.lit(width)
    f = px.groupBy("img").agg(right.alias("_w"), (F.max("y") + 1).alias("_h"))
    rows = f.select("img", "_w", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("y"))
    every = rows.select("img", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("x"), "y", "_w")
    at = every.select("img", (F.col("y").cast("bigint") * F.col("_w") + F.col("x")).alias("i"), "x", "y")
    return at.join(px.select("img", "x", "y", col), ["img", "x", "y"], "left").select("img", "i", "x", "y", F.coalesce(F.col(col), F.lit(fill)).alias(col))


def components(mask: DataFrame, col: str) -> DataFrame:
    """``mask`` (img, i, x, y, ``col``) with root, the smallest i of the 4-connected component of equal values."""
    return cut(mask.join(R.grow(mask, col), ["img", "i"]).select("img", "i", "x", "y", col, "root"))


def loops(px: DataFrame, col: str, least: int) -> DataFrame:
    """(img, loop, root, area, hole, inside): the components of 1 of at least ``least`` pixels, and the components of 0 that touch no side of the frame and are as large
    (holes), numbered by root. ``inside``: of a hole, the component around it, which holds the pixel above the hole's first."""
    sides = R.frames(px)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("right")) | (F.col("y") == F.col("bottom"))
    stats = px.join(sides, "img").groupBy("img", "root", F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("area"), F.max(edge).alias("edge"), F.min("right").alias("right"))
    kept = stats.where((F.col("area") >= least) & ((F.col("v") == 1) | ~F.col("edge")))
    above = kept.withColumn("at", F.when(F.col("v") == 0, F.col("root") - F.col("right") - 1))
    around = px.select("img", F.col("i").alias("at"), F.col("root").alias("inside"))
    number = (F.row_number().over(Window.partitionBy("img").orderBy("root")) - 1).alias("loop")
    return above.join(around, ["img", "at"], "left").select("img", number, "root", "area", (F.col("v") == 0).alias("hole"), "inside")


def _codes(px: DataFrame) -> DataFrame:
    """px and code: bit d is set if the neighbour in direction d belongs to the same component. The raster must be complete."""
    row = px.withColumn("_r", F.struct(F.lag("root").over(R.row_window()).alias("w"), F.col("root").alias("c"), F.lead("root").over(R.row_window()).alias("e")))
    near = row.withColumns({"_n": F.lag("_r").over(R.col_window()), "_s": F.lead("_r").over(R.col_window())})
    order = ["_r.w", "_n.w", "_n.c", "_n.e", "_r.e", "_s.e", "_s.c", "_s.w"]
    bits = [F.when(F.col(c) == F.col("root"), 1 << d).otherwise(0) for d, c in enumerate(order)]
    return near.withColumn("code", reduce(Column.__add__, bits)).drop("_r", "_n", "_s")


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _pick(values: tuple, d: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), d + 1)


def border_order(px: DataFrame, chosen: DataFrame) -> DataFrame:
    """(img, loop, k, x, y): the outer border of each component in ``chosen`` (img, loop, root), clockwise from its first pixel until that is met again.

    Moore's rule: at a pixel one came to from direction ``back``, the next pixel is the first inside the component, clockwise after ``back``. Each (pixel, back) with an
    outside pixel behind it is a row with its successor; a step onto the first pixel has none."""
    width = R.frames(px).select("img", (F.col("right") + 1).alias("w"))
    edge = _codes(px).where("code < 255").join(chosen.select("img", "root", "loop"), ["img", "root"]).join(width, "img")
    state = edge.withColumn("back", F.explode(F.array(*(F.lit(b) for b in sorted(set(BEHIND)))))).where((_right(F.col("code"), F.col("back")) % 2) == 0)
    turned = _right(F.col("code") * 257, F.col("back") + 1).bitwiseAND(255)  # bit t: the neighbour t + 1 steps clockwise from back
    step = F.bit_count(turned.bitwiseAND(-turned) - 1)
    d = state.where(turned > 0).withColumn("d", (F.col("back") + 1 + step) % 8)
    to = F.col("i") + _pick(tuple(dy for _, dy in AROUND), F.col("d")) * F.col("w") + _pick(tuple(dx for dx, _ in AROUND), F.col("d"))
    # a pixel's state is i * 8 + back
    jump = cut(d.withColumn("to_i", to).where("to_i <> root").select("img", (F.col("i") * 8 + F.col("back")).alias("n"), (F.col("to_i") * 8 + _pick(BEHIND, F.col("d"))).alias("to")))
    placed = cut(chosen.select("img", "loop", (F.col("root") * 8).alias("n"), F.lit(0).alias("k")))
    length = 1
    while True:
        new = cut(placed.join(jump, ["img", "n"]).select("img", "loop", F.col("to").alias("n"), (F.col("k") + length).alias("k")))
        if not new.limit(1).count():
            break
        placed, length = cut(placed.union(new)), 2 * length
        jump = cut(jump.join(jump.select("img", F.col("n").alias("to"), F.col("to").alias("far")), ["img", "to"]).select("img", "n", F.col("far").alias("to")))
    at = F.floor(F.col("n") / 8)
    return placed.join(width, "img").select("img", "loop", "k", (at % F.col("w")).cast("int").alias("x"), F.floor(at / F.col("w")).cast("int").alias("y"))


def line_distance_sq(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of (x, y) to the line through a and b, or to a if they are one point."""
    u, v, p, q = bx - ax, by - ay, x - ax, y - ay
    length, cross = u * u + v * v, p * v - q * u
    return F.when(length == 0, p * p + q * q).otherwise(cross * cross / F.when(length != 0, length))


def simplified(points: DataFrame, epsilon: float) -> DataFrame:
    """Closed Douglas-Peucker of loops (img, loop, k, x, y): two arcs, from the first point to the one farthest from it and back, are split at their farthest points while these are
    more than ``epsilon`` off. Loops of up to four points stay. k keeps its values."""
    keys = ["img", "loop"]
    whole = points.select(*keys, "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    first = whole.where("k = 0").select(*keys, F.col("x").alias("ax"), F.col("y").alias("ay"))
    gap = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
    far = whole.join(first, keys).groupBy(*keys, "ax", "ay").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(gap.alias("d"), (-F.col("k")).alias("k"), "x", "y")).alias("m"))
    far = cut(far.select(*keys, "ax", "ay", "n", (-F.col("m.k")).alias("f"), F.col("m.x").alias("fx"), F.col("m.y").alias("fy")))
    split = far.where("n > 4 and f > 0")
    kept = [whole.join(far.where("n <= 4 or f = 0").select(*keys), keys, "left_semi"), split.select(*keys, F.lit(0).alias("k"), F.col("ax").alias("x"), F.col("ay").alias("y")), split.select(*keys, F.col("f").alias("k"), F.col("fx").alias("x"), F.col("fy").alias("y"))]
    out = F.col("k") < F.col("f")
    work = cut(
        whole.join(split, keys).where("k <> 0 and k <> f").select(
            *keys, "k", "x", "y", F.when(out, 0).otherwise(F.col("f")).alias("a"),
            *(F.when(out, F.col(f"a{c}")).otherwise(F.col(f"f{c}")).alias(f"a{c}") for c in "xy"), *(F.when(out, F.col(f"f{c}")).otherwise(F.col(f"a{c}")).alias(f"b{c}") for c in "xy"),
        )
    )
    while work.limit(1).count():
        off = line_distance_sq(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
        best = work.groupBy(*keys, "a").agg(F.max(F.struct(off.alias("d"), (-F.col("k")).alias("k"), "x", "y")).alias("m")).where(F.col("m.d") > epsilon * epsilon)
        best = cut(best.select(*keys, "a", (-F.col("m.k")).alias("f"), F.col("m.x").alias("fx"), F.col("m.y").alias("fy")))
        kept.append(best.select(*keys, F.col("f").alias("k"), F.col("fx").alias("x"), F.col("fy").alias("y")))
        before = F.col("k") < F.col("f")
        work = cut(
            work.join(best, [*keys, "a"]).where("k <> f").select(
                *keys, "k", "x", "y", F.when(before, F.col("a")).otherwise(F.col("f")).alias("a"),
                *(F.when(before, F.col(f"a{c}")).otherwise(F.col(f"f{c}")).alias(f"a{c}") for c in "xy"), *(F.when(before, F.col(f"f{c}")).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "xy"),
            )
        )
    return reduce(DataFrame.union, kept)


def corners_cut(points: DataFrame, rounds: int, sharp_degrees: float = SHARP) -> DataFrame:
    """Chaikin's corner cutting of loops (img, loop, k, x, y): each point gives way to two, a quarter of the way to its neighbours; points that turn by more than
    ``sharp_degrees`` stay. k becomes 0, 1, ... in order. Loops of one or two points stay."""
    limit = math.cos(math.radians(sharp_degrees))
    w = Window.partitionBy("img", "loop").orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(w) - 1).alias("k")
    line = points.select("img", "loop", place, *(F.col(c).cast("double").alias(c) for c in "xy"))
    for _ in range(rounds):
        near = {f"{p}{c}": F.coalesce(f(c).over(w), g(c).over(whole)) for c in "xy" for p, f, g in (("p", F.lag, F.last), ("n", F.lead, F.first))}
        at = line.withColumns({**near, "size": F.count(F.lit(1)).over(whole)})
        u, v = (F.col("x") - F.col("px"), F.col("y") - F.col("py")), (F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
        length = F.sqrt(u[0] * u[0] + u[1] * u[1]) * F.sqrt(v[0] * v[0] + v[1] * v[1])
        turn = F.when(length > 0, (u[0] * v[0] + u[1] * v[1]) / F.when(length > 0, length)).otherwise(1.0)
        to = lambda p: F.struct(*((F.col(c) + 0.25 * (F.col(f"{p}{c}") - F.col(c))).alias(c) for c in "xy"))
        both = F.when((F.col("size") < 3) | (turn < limit), F.array(F.struct("x", "y"))).otherwise(F.array(to("p"), to("n")))
        line = at.select("img", "loop", "k", F.posexplode(both).alias("s", "q")).select("img", "loop", (F.row_number().over(Window.partitionBy("img", "loop").orderBy("k", "s")) - 1).alias("k"), "q.*")
    return line


def outlines(mask: DataFrame, col: str, least: int) -> DataFrame:
    """(img, loop, k, x, y): borders of the components and holes of a complete 0/1 raster."""
    px = components(mask, col)
    return border_order(px, loops(px, col, least))
