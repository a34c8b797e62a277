"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are bags of hashed words and word pairs over ``BUCKETS`` buckets with add-one smoothing, counted over all documents (raw) and
over the target documents. A document's log weight is the sum of log p_target - log p_raw over its features. Adding
Gumbel noise and taking the k greatest sums draws k documents without replacement in proportion to the weights.

The counts are ``BUCKETS`` pairs whatever the input, so the driver and the broadcast stay bounded; the k-th greatest key is found by
histograms, not by a global sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, slices, small

BUCKETS, PAGE = 1 << 16, 4096


@lru_cache(maxsize=100_000)
def _word(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w)


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and word pairs of a text (lower-cased A-Z, split at white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pairs ^ (pairs >> np.uint64(29))]) % np.uint64(buckets)).astype(np.int64)


def models(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket. ``target``: ids of target documents. Without any, all zeros."""
    ship(docs.sparkSession)
    ids = materialise(target.select(F.col(target.columns[0]).alias("t_id")).where("t_id is not null").distinct(), "target")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(ids), F.col("id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, buckets), np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [features(t, buckets) for t in b.column("text").to_pylist()]
                good = np.repeat(np.asarray(b.column("good").to_pylist(), bool), [len(s) for s in sets])
                flat = np.concatenate(sets)
                count[0] += np.bincount(flat, minlength=buckets)
                count[1] += np.bincount(flat[good], minlength=buckets)
        used = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[0][used]), pa.array(count[1][used])], ["bucket", "raw", "target"])

    rows = src.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    count = np.ones((2, buckets))
    at = np.asarray(rows.column("bucket"))
    count[0][at] += np.asarray(rows.column("raw"))
    count[1][at] += np.asarray(rows.column("target"))
    if count[1].sum() == buckets:
        return np.zeros(buckets)
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, log_weight, gumbel_key) of each row. The noise depends on seed, id and text alone, so reruns agree."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    noise = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), noise.alias("noise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for b in (part for whole in batches for part in slices(whole, "text")):
            sets = [features(t, len(r)) for t in b.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            w = np.array([r[s].sum() for s in sets])
            u = ((np.asarray(b.column("noise")).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(w), pa.array(w - np.log(-np.log(u)))], ["id", "n_features", "log_weight", "gumbel_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_features bigint, log_weight double, gumbel_key double")


def threshold(keyed: DataFrame, k: int, col: str = "gumbel_key") -> tuple[float, int]:
    """The k-th greatest value and how many rows equal to it belong to the k greatest, by narrowing histograms of ``PAGE``
    bins. ``keyed`` should be a written table; k is at least 1 and at most its rows."""
    lo, hi = keyed.agg(F.min(col), F.max(col)).first()
    above = 0
    while hi > lo:
        width = (hi - lo) / PAGE
        if not width or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col(col) - lo) / width), F.lit(PAGE - 1))
        rows = keyed.where(F.col(col).between(lo, hi)).groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo, k - above


def resample(docs: DataFrame, target: DataFrame, share: float = 0.5, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, log_weight, gumbel_key, selected) for each document row: ceil(share * rows) rows are selected.

    Null and empty texts have no features and log weight 0. Rows that tie with the last selected key are taken by smallest id
    (nulls first). An empty table gives no rows. Extra columns are ignored."""
    keyed = materialise(weights(docs, models(docs, target, id_col, text_col), seed, id_col, text_col), "weights")
    n = keyed.count()
    if not n:
        return keyed.withColumn("selected", F.lit(False))
    last, room = threshold(keyed, min(n, math.ceil(share * n)))
    at = keyed.where(F.col("gumbel_key") == last)
    if at.count() == room:
        return keyed.withColumn("selected", F.col("gumbel_key") >= last)
    # ties: repeated rows share their noise; the first ``room`` by id stay
    tied = at.withColumn("selected", F.row_number().over(Window.partitionBy("gumbel_key").orderBy("id")) <= room)
    return keyed.where(F.col("gumbel_key") != last).withColumn("selected", F.col("gumbel_key") > last).union(tied)
