"""Palettes: seeded k-means in Lab over relations, and nearest-colour assignment as joins with a small palette.

Every image (or other group ``img``) runs its own k-means, all of them in the same rounds. No image's samples meet in one task: draws are made on running sums of
blocks of samples, then within the one block that a draw falls into, and each Lloyd step is one aggregate by image and colour. Images whose colours have
settled leave the loop. Rounds are cut off by tables written to the shared folder. In the rounds a palette is a row of numbers that each of its image's samples meets;
distances to its colours are written out one by one, so that they are compiled, and nothing but sums leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import random32
from ..shipping import light
from ..shipping import stored as cut

MAX_SAMPLES, MAX_ITERATIONS, CONVERGED_SQ, DUPLICATE, SEED = 80_000, 20, 0.0025, 2.0, 0x9E3779B9
BLOCK = 512
#: So many colours of all palettes together go to all tasks (some tens of MB); with more of them, samples are shuffled to their image's palette.
SENT = 1_000_000
LAB = ("l", "a", "b")


def nearest(value: Column, palette: Column) -> Column:
    """Index of the nearest (idx, l, a, b) entry of an array to an (l, a, b) struct; ties go to the lowest index."""
    return F.array_min(F.transform(palette, lambda c: F.struct(apart(value, c).alias("d"), c["idx"].alias("idx"))))["idx"]


def apart(x: Column, y: Column) -> Column:
    """Squared distance of two (l, a, b) structs."""
    return sum((x[k].cast("double") - y[k].cast("double")) * (x[k].cast("double") - y[k].cast("double")) for k in LAB)


def palette_arrays(centroids: DataFrame, *keys: str) -> DataFrame:
    """A row for each image (and part) with its palette as one array; a palette has some dozens of entries."""
    return centroids.groupBy("img", *keys).agg(F.array_sort(F.collect_list(F.struct("idx", *LAB))).alias("palette"))


def assign(pixels: DataFrame, centroids: DataFrame, part: str | None = None) -> DataFrame:
    """``pixels`` (with a lab struct) and idx, the nearest centroid of the image (and of the pixel's own ``part``). A join by image,
    then codegen-free array search over the few colours; no pixel-by-colour rows arise."""
    keys = ["img", *([part] if part else [])]
    return pixels.join(palette_arrays(centroids, *keys[1:]), keys).withColumn("idx", nearest(F.col("lab"), F.col("palette"))).drop("palette")


def lloyd_step(pixels: DataFrame) -> DataFrame:
    """Mean colour of each (img, idx): one step of k-means after ``assign``."""
    return pixels.groupBy("img", "idx").agg(*(F.avg(F.col(f"lab.{c}").cast("double")).alias(c) for c in LAB), F.count(F.lit(1)).alias("n"))


def samples(pixels: DataFrame, order: str = "i", limit: int = MAX_SAMPLES) -> DataFrame:
    """(img, j, block, lab, n): every stride-th pixel of each image by ``order``, at most about ``limit`` of them, numbered from 0; n is their number. ``pixels`` has img, ``order`` and
    the floats l, a, b.

    Pixels are numbered by blocks of ``order``: their counts, running sums over the few blocks, then places within a block."""
    width = BLOCK * 8
    px = pixels.select("img", F.floor(F.col(order) / width).alias("_b"), F.col(order).alias("_o"), F.struct(*(F.col(c).cast("float").alias(c) for c in LAB)).alias("lab"))
    per = px.groupBy("img", "_b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("img")
    before = per.select("img", "_b", (F.sum("c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("base"), F.sum("c").over(w).alias("all"))
    placed = px.withColumn("_k", F.row_number().over(Window.partitionBy("img", "_b").orderBy("_o")) - 1)
    stride = F.greatest(F.lit(1), F.floor(F.col("all") / limit))
    kept = placed.join(light(cut(before)), ["img", "_b"]).withColumns({"at": F.col("base") + F.col("_k"), "stride": stride}).where(F.col("at") % F.col("stride") == 0)
    j = F.floor(F.col("at") / F.col("stride"))
    return kept.select("img", j.alias("j"), F.floor(j / BLOCK).alias("block"), "lab", F.ceil(F.col("all") / F.col("stride")).alias("n"))


def _sent(palettes: DataFrame, k: int) -> Callable[[DataFrame], DataFrame]:
    """A hint for tables with a row for each image of ``palettes`` at most."""
    few = palettes.limit(SENT // k + 1).count() <= SENT // k
    return F.broadcast if few else lambda df: df


def _met(x: DataFrame, palettes: DataFrame, k: int, by: str | list[str] = "img") -> DataFrame:
    """Samples (with lab) that met the ``k`` colours of their image; other columns of ``palettes`` come along."""
    flat = palettes.select("*", *(F.get("colors", F.lit(i))[c].cast("double").alias(f"_{c}{i}") for i in range(k) for c in LAB)).drop("colors")
    return x.withColumns({f"_{c}": F.col(f"lab.{c}").cast("double") for c in LAB}).join(flat, by)


def _to(i: int) -> Column:
    """Squared distance of a sample to the i-th colour that it met; null if its palette has fewer."""
    d = [F.col(f"_{c}") - F.col(f"_{c}{i}") for c in LAB]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _starts(x: DataFrame, k: int, seed: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(img, n, colors) with the starting points of ``spread_start`` in order, and the hint for tables of that many rows."""
    draw = lambda i: random32(F.lit(seed), F.lit(i))
    first = F.greatest(F.lit(0), F.ceil(draw(0) * F.col("n")).cast("bigint") - 1)
    held = cut(x.where(F.col("j") == first).select("img", "n", F.array("lab").alias("colors")))
    sent = _sent(held, k)
    every = Window.partitionBy("img")
    w = every.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("img", "block").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    near = [_to(i).cast("float") for i in range(k - 1)]
    for i in range(1, k):
        least, goal = _least(near[:i]).cast("double"), draw(i) * F.col("total")
        live, px = held.where(F.col("n") > i), x.where(F.col("n") > i).select("img", "j", "block", "lab")
        sums = _met(px, sent(live.select("img", "colors")), i).groupBy("img", "block").agg(F.sum(least).alias("s"))
        run = sums.withColumn("upto", F.sum("s").over(w)).withColumn("total", F.max("upto").over(every))
        reached = F.min(F.when(F.col("upto") >= goal, F.struct("block", (F.col("upto") - F.col("s")).alias("base"))))
        hit = run.groupBy("img", "total").agg(reached.alias("h")).join(sent(live), "img")
        hit = hit.select("img", "total", "colors", F.col("h.base").alias("base"), F.coalesce(F.col("h.block"), F.floor((F.col("n") - 1) / BLOCK)).alias("block"))
        within = _met(px, sent(hit), i, ["img", "block"]).select("img", "block", "j", "lab", "total", "base", least.alias("least"))
        within = within.withColumn("upto", F.col("base") + F.sum("least").over(inside))
        reached = F.min(F.when(F.col("upto") >= goal, F.struct("j", "lab")))
        found = within.groupBy("img", "total").agg(F.coalesce(reached, F.max(F.struct("j", "lab"))).alias("m"))
        point = F.when(F.col("total") == 0, F.col("colors")[0]).otherwise(F.col("m.lab"))
        held = cut(held.join(found, "img", "left").select("img", "n", F.when(F.col("m").isNull(), F.col("colors")).otherwise(F.concat("colors", F.array(point))).alias("colors")))
    return held, sent


def spread_start(x: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """(img, idx, lab): k-means++ starting points of samples (img, j, block, lab, n), min(k, n) for each image. ``x`` is read twice for each point, so it should be a stored table.

    The first one is drawn evenly, each further one with a weight of its squared distance (a float) to those before, as the first sample at which the running sum
    reaches a share of the total. If all weights are 0 the first point comes again; if rounding keeps the sum from its target the last sample is taken."""
    return _starts(x, k, seed)[0].select("img", F.posexplode("colors").alias("idx", "lab"))


def distinct_colors(palette: Column, near: float = DUPLICATE) -> Column:
    """The entries (idx, l, a, b, n) of an array that have pixels and are not within ``near`` of one kept before them, in order; the first entry if none is left."""
    far = lambda kept, c: ~F.exists(kept, lambda o: apart(o, c) < near * near)
    none = F.filter(palette, lambda _: F.lit(False))
    kept = F.aggregate(palette, none, lambda acc, c: F.when((c["n"] > 0) & far(acc, c), F.concat(acc, F.array(c))).otherwise(acc))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(palette, 1, 1))


def kmeans(pixels: DataFrame, k: int, seed: int = SEED, order: str = "i") -> DataFrame:
    """(img, idx, l, a, b as floats): the palette of each image of ``pixels`` (img, ``order``, l, a, b): seeded start, at most ``MAX_ITERATIONS`` Lloyd steps until no colour moves by
    more than the limit, near-equal colours merged into the first. Images without pixels have none."""
    x = cut(samples(pixels, order))
    start, sent = _starts(x, k, seed)
    book = start.select("img", F.transform("colors", lambda c: F.struct(*(c[m].alias(m) for m in LAB), F.lit(0).cast("bigint").alias("n"))).alias("colors"))
    # what a round computes, put together once
    d = [F.col(f"_d{i}") for i in range(k)]
    far, least = [_to(i).alias(f"_d{i}") for i in range(k)], _least(d).alias("_m")
    own = reduce(lambda o, i: o.when(d[i] == F.col("_m"), i), range(1, k), F.when(d[0] == F.col("_m"), 0)).otherwise(0)
    by_place = F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*LAB, "n"))))
    found = lambda i, m: F.try_element_at("mean", i)[m]
    to = F.transform("colors", lambda c, i: F.struct(*(F.coalesce(found(i, m), c[m].cast("double")).alias(m) for m in LAB), F.coalesce(found(i, "n"), F.lit(0)).alias("n")))
    moved = F.array_max(F.transform("colors", lambda c, i: apart(F.get("to", i), c)))
    floats = F.transform("to", lambda c: F.struct(*(c[m].cast("float").alias(m) for m in LAB), c["n"].alias("n")))
    settled = []
    for _ in range(MAX_ITERATIONS):
        near = _met(x.select("img", "lab"), sent(book.select("img", "colors")), k).select("img", "lab", *far)
        near = near.select("img", "lab", *d, least).select("img", "lab", own.alias("idx"))
        mean = lloyd_step(near).groupBy("img").agg(by_place.alias("mean"))
        step = mean.join(sent(book), "img").withColumn("to", to)
        book = cut(step.select("img", floats.alias("colors"), (moved < CONVERGED_SQ).alias("done")))
        settled.append(book.where("done"))
        book = book.where("not done")
        if not book.limit(1).count():
            break
    last = reduce(DataFrame.union, [*settled, book])
    return last.select("img", F.posexplode(distinct_colors(F.col("colors"))).alias("idx", "c")).select("img", "idx", *(F.col(f"c.{c}").alias(c) for c in LAB))
