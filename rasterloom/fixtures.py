"""Rasters derived from the supplied tables, as relations of pixels, and the same rows in SQL.

Every raster has (img, i, x, y, ...) with i = y * width + x inside its image; a table gives as many images as it has rows
for. Images are the unit of partitioning: all operators group by ``img``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width and height of the images of each raster.
ORD, PART, EMB = (125, 40), (50, 10), (64, 50)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(df: DataFrame, key: str, size: tuple[int, int]) -> DataFrame:
    n = size[0] * size[1]
    i = F.col(key) % n
    return df.withColumns({"img": F.floor(F.col(key) / n), "i": i, "x": (i % size[0]).cast("int"), "y": F.floor(i / size[0]).cast("int")})


def r_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB raster with a confidence mask (0-255), from orders."""
    df = _placed(load(spark, sf_dir, "orders"), "o_orderkey", ORD)
    return df.select("img", "i", "x", "y", (F.floor("o_totalprice") % 256).cast("int").alias("r"), (F.col("o_custkey") % 256).cast("int").alias("g"), (F.col("o_orderkey") * 7 % 256).cast("int").alias("b"), (F.col("o_custkey") * 13 % 256).cast("int").alias("conf"))


def r_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map of palette indexes 0..3, from part."""
    return _placed(load(spark, sf_dir, "part"), "p_partkey", PART).select("img", "i", "x", "y", F.floor(F.col("p_size") / 13).cast("int").alias("idx"))


def r_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar raster of embedding components, a row of 64 pixels for each vector, and its two-level index map."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    v = F.col("v").cast("double")
    y = (F.col("vec_id") % EMB[1]).cast("int")
    idx = F.least(F.lit(1), F.greatest(F.lit(0), F.floor((v + 0.6) / 1.2 * 2))).cast("int")
    return e.select(F.floor(F.col("vec_id") / EMB[1]).alias("img"), (y * 64 + F.col("x")).cast("bigint").alias("i"), "x", y.alias("y"), v.alias("v"), idx.alias("idx"))


ORD_SQL = """ord as (select o_orderkey // 5000 img, o_orderkey % 5000 i, cast(o_orderkey % 125 as int) x, cast(o_orderkey % 5000 // 125 as int) y,
 cast(cast(floor(o_totalprice) as bigint) % 256 as int) r, cast(o_custkey % 256 as int) g, cast(o_orderkey * 7 % 256 as int) b, cast(o_custkey * 13 % 256 as int) conf from orders)"""
PART_SQL = """prt as (select p_partkey // 500 img, p_partkey % 500 i, cast(p_partkey % 50 as int) x, cast(p_partkey % 500 // 50 as int) y, cast(floor(p_size / 13.0) as int) idx from part)"""
EMB_SQL = """emb as (select vec_id // 50 img, cast(vec_id % 50 * 64 + x as bigint) i, cast(x as int) x, cast(vec_id % 50 as int) y, v, cast(least(1, greatest(0, floor((v + 0.6) / 1.2 * 2))) as int) idx
 from (select vec_id, unnest(range(64)) x, cast(unnest(embedding) as double) v from embeddings))"""
