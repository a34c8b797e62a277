"""Line deduplication by distinct-site spread, in DataFrame functions only.

1. Lines (trimmed) are hashed; the least and greatest site hash of each line tell which lines stand on one site only. That is a
   plain aggregate with map-side combining, and leaves few lines.
2. For those, HyperLogLog sketches of the sites are built in each map task and merged by the aggregation. A line on a third of all
   rows costs one sketch a task.
3. Lines whose estimate is within ``BAND`` of their threshold get exact distinct counts. (The sketches' relative error is 1.6 %,
   so the band is more than ten standard errors wide.)
4. Boilerplate lines are taken out of all documents but one, that with the smallest id, so no content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, row_key, small

SITES, LONG_SITES, LONG_WORDS, BAND, LG_K = 10, 2, 50, 0.2, 12


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(site_col).alias("site"), F.col(site_col).isNotNull().alias("known"), row_key(id_col, F.col(text_col)).alias("key"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return split.withColumn("line", line).where("line <> ''").select("id", "site", "known", "key", "pos", F.xxhash64("line").alias("h"), words.alias("words"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, long_sites: int = LONG_SITES, long_words: int = LONG_WORDS) -> DataFrame:
    """(h, keeper): hashes of the lines that stand on at least ``sites`` sites (``long_sites`` if they have
    ``long_words`` words, counted by spaces), and the smallest id that has them. Rows whose site is null count for no site."""
    lines = _lines(docs, id_col, text_col, site_col)
    known = lines.where("known")
    spread = known.groupBy("h").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.max("words").alias("words")).where("lo <> hi")
    need = F.when(F.col("words") >= long_words, F.lit(long_sites)).otherwise(F.lit(sites))
    several = materialise(spread.select("h", need.alias("need")), "lines")
    met = known.join(small(several), "h")
    sketched = materialise(met.groupBy("h", "need").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("est")), "sketches")
    near = sketched.where((F.col("est") >= F.floor(F.col("need") * (1 - BAND))) & (F.col("est") <= F.ceil(F.col("need") * (1 + BAND))))
    exact = known.join(small(near.select("h", "need")), "h").groupBy("h", "need").agg(F.count_distinct("site").alias("n")).where("n >= need").select("h")
    sure = sketched.where(F.col("est") > F.ceil(F.col("need") * (1 + BAND))).select("h")
    wide = materialise(sure.union(exact), "wide")
    return materialise(lines.join(small(wide), "h").groupBy("h").agg(F.min("id").alias("keeper")), "boilerplate")


def without(lines: Column, places: Column) -> Column:
    """An array without the elements at the given places (sorted, from 0): the stretches between them, joined."""
    ends = F.concat(places, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, long_sites: int = LONG_SITES, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and two more columns at the end, _n_lines and _n_removed (with more underscores
    if ``docs`` has columns of these names).

    The document with the smallest id keeps the line. Null texts stay null with 0 lines; empty lines are never removed; a text
    whose every line goes becomes ''. Long texts and long lines are taken whole. Repeated rows, also under a null id, are treated alike: all of them
    keep or lose a line; of equal least ids (or none) all rows keep it. Rows without a site count for no site but lose lines like others. An
    empty table gives no rows. All columns of ``docs`` are returned."""
    bad = boilerplate(docs, id_col, text_col, site_col, sites, long_sites, long_words)
    hits = _lines(docs, id_col, text_col, site_col).join(small(bad), "h").where(~F.col("id").eqNullSafe(F.col("keeper")))
    per = hits.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    p = per.select(F.col("key.id").alias("p_id"), F.col("key.h").alias("p_h"), F.col("key.n").alias("p_n"), "places").alias("p")
    k = fresh("_k", docs.columns)
    d = docs.withColumn(k, row_key(id_col, F.col(text_col))).alias("d")
    both = d.join(p, F.col(f"d.{k}.id").eqNullSafe(F.col("p.p_id")) & (F.col(f"d.{k}.h") == F.col("p.p_h")) & F.col(f"d.{k}.n").eqNullSafe(F.col("p.p_n")), "left")
    lines = F.split(F.col(f"d.{text_col}"), "\n")
    text = F.when(F.col("p.places").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(without(lines, F.col("p.places")), "\n"))
    cols = [text.alias(c) if c == text_col else F.col(f"d.`{c.replace('`', '``')}`") for c in docs.columns]
    return both.select(*cols, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(fresh("_n_lines", docs.columns)), F.coalesce(F.size("p.places"), F.lit(0)).cast("long").alias(fresh("_n_removed", docs.columns)))
