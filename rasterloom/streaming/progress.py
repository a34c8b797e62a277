"""Fill events as a stream: progress of puzzles as keyed state, equal to the batch fold over the same events."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import accepted, taps, upsert
from ..shipping import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STATE = "puzzle bigint, region int, ord struct<ts: timestamp_ntz, event_id: bigint>, fill string"
#: Keys are dealt to so many buckets; a batch writes those anew that it changes.
BUCKETS = 64


def last_batch(spark: SparkSession, base: str) -> int | None:
    """The last batch that the stream's checkpoint holds as finished."""
    try:
        done = spark.read.format("binaryFile").load(f"{base}/offsets/commits")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return done.select(F.max(F.regexp_extract("path", r"/(\d+)$", 1).try_cast("bigint"))).first()[0]


def _versions(spark: SparkSession, base: str, number: int | None) -> dict[int, int]:
    """Of each bucket, the batch that wrote it last, as of batch ``number``: at most ``BUCKETS`` entries."""
    if number is None or number < 0:
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch bigint").parquet(f"{base}/manifest-{number}").collect()}


def _state(spark: SparkSession, base: str, versions: dict[int, int]) -> DataFrame | None:
    parts = [spark.read.schema(f"{STATE}, bucket int").parquet(f"{base}/version-{v}").where(F.col("bucket").isin([b for b in versions if versions[b] == v])) for v in sorted(set(versions.values()))]
    return reduce(DataFrame.union, parts) if parts else None


def stream_fills(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_a_trigger: int = 1, out: str | None = None) -> DataFrame:
    """(puzzle, region, ord, fill) after all events of a folder have been read as a stream. Called again with the same ``out``, it goes on from where it
    stopped: only new files are read, and without any the state is as it was.

    Each micro-batch is reduced to one row for each key and merged with the buckets of keys that it touches; these are written under the number of the batch,
    with a manifest of which batch wrote each bucket last. So a batch that runs again after a failure writes the same ones, and a batch
    costs what it changes. The offsets are in the stream's checkpoint, beside the buckets."""
    base = out or f"{shared_folder(spark)}/fills-{uuid.uuid4().hex}"
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    fills = accepted(taps(source)).select("puzzle", "region", F.struct("ts", "event_id").alias("ord"), "fill")

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        new = upsert(None, batch, ["puzzle", "region"], "ord").withColumn("bucket", F.pmod(F.xxhash64("puzzle", "region"), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        versions = _versions(s, base, number - 1)
        old = _state(s, base, {b: v for b, v in versions.items() if b in touched})
        upsert(old, new, ["puzzle", "region", "bucket"], "ord").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/version-{number}")
        manifest = sorted((versions | dict.fromkeys(touched, number)).items())
        s.createDataFrame(manifest, "bucket int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest-{number}")
        new.unpersist()

    q = fills.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    state = _state(spark, base, _versions(spark, base, last_batch(spark, base)))
    return spark.createDataFrame([], STATE) if state is None else state.drop("bucket")
