"""Square windows around pixels, with a row of an image as one array.

Each row of pixels becomes one array, and meets the rows around it by a window over its image: 2 radius + 1 references a row in place of (2 radius + 1) squared rows a pixel. What lies around
a pixel is then cut out of these arrays, and no pixel is shuffled more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(px: DataFrame, columns: list[str], radius: int, value: Callable[[Column, Column], Column], tables: dict[str, Column] | None = None) -> DataFrame:
    """(img, i, x, y, v) with v = ``value``(pixel, taps): a pixel is a struct of x, i and ``columns``, its taps are an array of structs of q (such a pixel) and dy, for all pixels that exist within
    ``radius`` columns and rows. ``tables``: further columns, the same for all rows, that ``value`` may use."""
    row = F.array_sort(F.collect_list(F.struct("x", "i", *columns)))
    rows = px.groupBy("img", "y").agg(row.alias("row")).withColumns({"x0": F.col("row")[0]["x"], "x1": F.element_at("row", -1)["x"]})
    # rows with gaps are filled up with nulls, so that places are indexes
    whole = F.when(F.size("row") == F.col("x1") - F.col("x0") + 1, F.col("row")).otherwise(F.transform(F.sequence("x0", "x1"), lambda x: F.get(F.filter("row", lambda e: e["x"] == x), F.lit(0))))
    rows = rows.select("img", "y", F.struct("y", "x0", whole.alias("row")).alias("own"))
    w = Window.partitionBy("img").orderBy("y")
    near = F.array(*(F.lead("own", k).over(w) if k > 0 else F.lag("own", -k).over(w) if k < 0 else F.col("own") for k in range(-radius, radius + 1)))
    bands = rows.withColumn("near", near).withColumn("near", F.filter("near", lambda r: r.isNotNull() & (F.abs(r["y"] - F.col("y")) <= radius)))

    def taps(p: Column) -> Column:
        def cut(r: Column) -> Column:
            at = p["x"] - r["x0"] + 1
            first = F.greatest(F.lit(1), at - radius)
            return F.transform(F.slice(r["row"], first, F.greatest(F.lit(0), at + radius - first + 1)), lambda q: F.struct(q.alias("q"), (r["y"] - F.col("y")).alias("dy")))

        return F.filter(F.flatten(F.transform("near", cut)), lambda t: t["q"].isNotNull())

    bands = bands.withColumns(tables) if tables else bands
    each = F.transform(F.filter("own.row", lambda p: p.isNotNull()), lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"), value(p, taps(p)).alias("v")))
    return bands.select("img", "y", F.explode(each).alias("e")).select("img", "e.i", "e.x", "y", "e.v")
