"""Images turned upright and shrunk, as maps of coordinates: a pixel's new place follows from its old one and its image's frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regions as R


def turned(px: DataFrame, orientation: Column) -> DataFrame:
    """``px`` (img, x, y, ...) with x and y as they are after an image of orientation 1 to 8 (as cameras note it) has been turned upright. Other numbers count as 1."""
    cols = px.columns
    at = px.withColumn("_o", orientation).join(R.frames(px), "img")
    x, y, mx, my = F.col("x"), F.col("y"), F.col("right") - F.col("x"), F.col("bottom") - F.col("y")
    places = {2: (mx, y), 3: (mx, my), 4: (x, my), 5: (y, x), 6: (my, x), 7: (my, mx), 8: (y, mx)}
    pick = lambda k: F.coalesce(*(F.when(F.col("_o") == o, p[k]) for o, p in places.items()), (x, y)[k])
    return at.withColumns({"_x": pick(0), "_y": pick(1)}).drop("x", "y", "right", "bottom", "_o").withColumnsRenamed({"_x": "x", "_y": "y"}).select(*cols)


def fit_inside(px: DataFrame, edge: int, columns: list[str], by: tuple[str, ...] = ("img",)) -> DataFrame:
    """(by, x, y, means of ``columns``) of images shrunk so that neither side exceeds ``edge``; smaller ones keep their size. A pixel is the mean of its box, whose bounds are floor and
    ceiling, so boxes may overlap."""
    size = px.groupBy(*by).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest("w", "h"))
    to = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale + 0.5)).cast("int")
    sized = size.withColumns({"tw": to("w"), "th": to("h")})

    def boxes(c: str, n: str, m: str) -> Column:
        """The boxes that hold a place: at most those beside the one it falls into."""
        mid = F.floor(F.col(c) * F.col(m) / F.col(n)).cast("int")
        near = F.sequence(F.greatest(F.lit(0), mid - 1), F.least(F.col(m) - 1, mid + 1))
        return F.filter(near, lambda o: (F.floor(o * F.col(n) / F.col(m).cast("double")) <= F.col(c)) & (F.ceil((o + 1) * F.col(n) / F.col(m).cast("double")) > F.col(c)))

    wide = px.join(sized, list(by)).withColumn("ox", F.explode(boxes("x", "w", "tw")))
    both = wide.withColumn("oy", F.explode(boxes("y", "h", "th")))
    return both.groupBy(*by, F.col("ox").alias("x"), F.col("oy").alias("y")).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns))
