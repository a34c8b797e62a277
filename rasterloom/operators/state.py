"""Keyed state as relations: upserts, deletes, fill events, completion, and the incremental build plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import PRESETS
from ..shipping import cut

SELECTED = ("click", "error", "purchase", "signup", "view")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` for each key; an aggregate with map-side combining, so a hot key is no burden."""
    rows = new if old is None else old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def map_set(m: Column, key: Column, value: Column) -> Column:
    """The map with one entry set; the other entries stay as they are."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def taps(events: DataFrame) -> DataFrame:
    """Fill attempts: puzzle, region, the region's own colour and the selected one."""
    k = F.get_json_object("props", "$.k").cast("int")
    chosen = F.array_position(F.array(*map(F.lit, SELECTED)), F.col("event_type")).cast("int")
    return events.select("event_id", "ts", F.col("user_id").alias("puzzle"), k.alias("region"), (k % 5 + 1).alias("color_no"), chosen.alias("selected"))


def matched_fill() -> Column:
    """The palette colour of a tap whose selected colour is the region's own, else null."""
    return F.when(F.col("selected") == F.col("color_no"), F.get(F.array(*map(F.lit, PRESETS[:5])), F.col("color_no") - 1))


def accepted(t: DataFrame) -> DataFrame:
    return t.withColumn("fill", matched_fill()).where("fill is not null")


def fills(ok: DataFrame) -> DataFrame:
    """(puzzle, region, fill): the last accepted fill."""
    return ok.groupBy("puzzle", "region").agg(F.max_by("fill", F.struct("ts", "event_id")).alias("fill"))


def completion(ok: DataFrame, regions: int) -> DataFrame:
    n = ok.select("puzzle", "region").distinct().groupBy("puzzle").agg(F.count(F.lit(1)).alias("filled"))
    return n.withColumn("complete", F.col("filled") >= regions)


def finishing_events(ok: DataFrame, regions: int) -> DataFrame:
    """(puzzle, finishing_event): the event whose fill makes the puzzle complete, for those that are. First fills of each region are found
    by an aggregate; only they are ordered within a puzzle."""
    first = ok.groupBy("puzzle", "region").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("puzzle").orderBy("at"))
    return first.withColumn("k", rank).where(F.col("k") == regions).select("puzzle", F.col("at.event_id").alias("finishing_event"))


def build_plan(now: DataFrame, cache: DataFrame, manifest: DataFrame, assets: DataFrame) -> DataFrame:
    """(slug, status): 'reuse' if the hash is the cached one, the manifest has exactly three entries and the assets exist; else
    'pending'."""
    j = now.join(cache.withColumnRenamed("sha1", "cached"), "slug", "left").join(manifest, "slug", "left").join(assets.withColumn("there", F.lit(True)), "slug", "left")
    same = (F.col("sha1") == F.col("cached")) & (F.col("entries") == 3) & F.col("there")
    return j.select("slug", F.when(same, "reuse").otherwise("pending").alias("status"))


def global_rank(df: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """Adds the place (from 1) of each row in the order of ``by``, which must be unique. Rows are dealt out by range and counted in each
    range; only the counts of ranges, one for each partition, are put together."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(w), F.lit(0))).select("_p", "_before")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*by)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_p").withColumn(name, place.cast("bigint")).drop("_p", "_before")


def place_within(df: DataFrame, keys: list[str], by: list[str | Column], name: str) -> DataFrame:
    """Adds the place (from 1) of each row among those of its keys, in the order of ``by``; keys and ``by`` together must be unique. Rows go by
    range and not by key, so a key with a third of all rows is spread over tasks; places count from the key's first."""
    ranked = cut(global_rank(df, [*keys, *by], "_at"))
    first = ranked.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("_at").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranked.join(first, same).withColumn(name, F.col("_at") - F.col("_first") + 1).select(*df.columns, name)
