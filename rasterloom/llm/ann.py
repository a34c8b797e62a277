"""Nearest neighbours from balanced posting lists.

Fit: centroids of a sample of at most ``SAMPLE`` vectors, by k-means with a penalty on large lists; at most ``MAX_LISTS`` of
them, about one for ``LIST`` vectors. A graph of near centroids is kept in memory (bounded by ``MAX_LISTS``) and
searched best-first for batches of vectors. Every vector of the table is indexed: it goes to its nearest list and, near a
boundary, to further lists (those within ``1 + near`` of the least distance, unless their centroid is almost that of a list chosen before).

Search: a query's lists are those that the graph search finds within ``1 + ratio`` of its least centroid distance. Lists
and their queries are dealt out in blocks of bounded size, so a list that holds a third of all vectors is spread over many tasks. Each
block keeps its k nearest, in exact double precision; a window takes the k nearest of those. Queries whose lists hold fewer than k
others (a vector that has a list to itself, or shares it with a few copies) are searched again over as many of the next lists as hold k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, small

SAMPLE, LIST, MAX_LISTS, VECTORS_A_BLOCK, QUERIES_A_BLOCK, COPIES = 20_000, 256, 4096, 4096, 1024, 4


@dataclass
class CentroidGraph:
    """Centroids, the links of each to near and to some far ones, and the entry points of a search."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int, rounds: int = 12, degree: int = 24, seed: int = 7) -> CentroidGraph:
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), k, replace=False)].copy()
        load = np.ones(k)
        for _ in range(rounds):
            d = _sq(x, c)
            spread = np.median(d.min(axis=1)) if len(x) else 0.0
            own = np.argmin(d + 0.1 * spread * load / load.mean(), axis=1)  # large lists look farther away
            load = np.bincount(own, minlength=k).astype(float)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            c = np.where(load[:, None] > 0, total / np.maximum(load, 1)[:, None], c)
            load = np.maximum(load, 1)
        near = np.argsort(_sq(c, c), axis=1)[:, 1 : degree + 1]
        far = rng.integers(0, k, (k, max(1, degree // 3)))
        return cls(c, np.concatenate([near, far], axis=1) if k > 1 else np.zeros((1, 1), int), np.unique(rng.integers(0, k, min(k, 32))))

    def search(self, q: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``breadth`` nearest centroids that a best-first walk finds, nearest first, for each row; id 0 at an
        infinite distance where it finds fewer.

        A row keeps its ``breadth`` nearest so far. In each step the nearest of these not yet followed are, and what they link to competes
        for a place, so a step costs as much as the frontier is broad, however many centroids there are."""
        m, k = len(q), len(self.centroids)
        breadth = min(breadth, k)
        seen = np.zeros((m, k), bool)
        dist, ids, ahead = np.full((m, breadth), np.inf), np.zeros((m, breadth), np.int64), np.zeros((m, breadth), bool)
        at_once = 1 if breadth <= 64 else 4

        def meet(rows: np.ndarray, others: np.ndarray) -> None:
            others = np.sort(others, axis=1)
            new = ~seen[rows[:, None], others]
            new[:, 1:] &= others[:, 1:] != others[:, :-1]
            seen[rows[:, None], others] = True
            a, b = np.nonzero(new)
            d = np.full(others.shape, np.inf)
            d[a, b] = np.sqrt(((q[rows[a]] - self.centroids[others[a, b]]) ** 2).sum(axis=1))
            every = np.concatenate([dist[rows], d], axis=1)
            stay = np.argpartition(every, breadth - 1, axis=1)[:, :breadth]
            pick = lambda x, y: np.take_along_axis(np.concatenate([x[rows], y], axis=1), stay, axis=1)
            dist[rows], ids[rows], ahead[rows] = np.take_along_axis(every, stay, axis=1), pick(ids, others), pick(ahead, new)

        alive = np.arange(m)
        meet(alive, np.tile(self.entries, (m, 1)))
        while len(alive):
            left = np.where(ahead[alive], dist[alive], np.inf)
            best = np.argpartition(left, at_once - 1, axis=1)[:, :at_once]
            go = np.isfinite(np.take_along_axis(left, best, axis=1)).any(axis=1)
            alive, best = alive[go], best[go]
            follow = np.take_along_axis(ids[alive], best, axis=1)
            ahead[alive[:, None], best] = False
            if len(alive):
                meet(alive, self.links[follow].reshape(len(alive), -1))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v as doubles: rows with an id and a vector that isn't null, empty or zero and holds only finite
    components, of the table's commonest length. Rows repeated under one id count once; of different vectors under one id the smallest
    (by its components in order) counts."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and x = x and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (lengths[0]["d"] if lengths else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def fit(vectors: DataFrame, seed: int = 7) -> CentroidGraph | None:
    """A graph over centroids of a sample of about ``SAMPLE`` rows of (vec_id, v); None without rows."""
    n = vectors.count()
    if not n:
        return None
    share = int(min(1.0, SAMPLE / n) * 1_000_000)
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < share).limit(2 * SAMPLE).select("v").toArrow()
    x = np.asarray(rows.column("v").combine_chunks().flatten(), np.float64).reshape(rows.num_rows, -1)
    if not len(x):
        x = np.array([vectors.first()["v"]])
    return CentroidGraph.fit(x, max(1, min(MAX_LISTS, math.ceil(n / LIST), len(x))), seed=seed)


def postings(vectors: DataFrame, graph: CentroidGraph, near: float = 0.1, copies: int = COPIES, breadth: int = 16) -> DataFrame:
    """(list, vec_id, v): every vector in its nearest list, and in further ones near a boundary."""
    ship(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                ids, d = g.search(_matrix(b.column("v")), breadth)
                rows, lists = [], []
                for i in range(len(ids)):
                    chosen: list[int] = []
                    for j, dj in zip(ids[i], d[i], strict=True):
                        if dj > (1 + near) * d[i, 0] or len(chosen) == copies:
                            break
                        if all(((g.centroids[j] - g.centroids[c]) ** 2).sum() > 0.1 * dj * dj for c in chosen):
                            chosen.append(int(j))
                    rows += [i] * len(chosen)
                    lists += chosen
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column("vec_id").take(pa.array(rows)), b.column("v").take(pa.array(rows))], ["list", "vec_id", "v"])

    return vectors.mapInArrow(run, "list int, vec_id bigint, v array<double>")


def probes(queries: DataFrame, graph: CentroidGraph, ratio: float, breadth: int) -> DataFrame:
    """(list, vec_id, v): the lists that a query looks into."""
    ship(queries.sparkSession)
    sent = queries.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                ids, d = g.search(_matrix(b.column("v")), breadth)
                rows, at = np.nonzero(d <= (1 + ratio) * d[:, :1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows, at], pa.int32()), b.column("vec_id").take(pa.array(rows)), b.column("v").take(pa.array(rows))], ["list", "vec_id", "v"])

    return queries.mapInArrow(run, "list int, vec_id bigint, v array<double>")


def wider(queries: DataFrame, graph: CentroidGraph, ratio: float, sizes: np.ndarray, vectors: int) -> DataFrame:
    """(list, vec_id, v): the lists of a query, by exact distance, up to that at which they hold ``vectors`` different vectors for certain (as
    a vector is in ``COPIES`` lists at most), and those within 1 + ratio of that distance; all lists if they hold fewer."""
    ship(queries.sparkSession)
    sent = queries.sparkSession.sparkContext.broadcast((graph, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held = sent.value
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                d = np.sqrt(_sq(_matrix(b.column("v")), g.centroids))
                order = np.argsort(d, axis=1, kind="stable")
                last = np.minimum((np.cumsum(held[order], axis=1) < COPIES * vectors).sum(axis=1), d.shape[1] - 1)
                ranks = np.argsort(order, axis=1)
                reach = np.take_along_axis(d, np.take_along_axis(order, last[:, None], axis=1), axis=1)
                rows, lists = np.nonzero(((ranks <= last[:, None]) | (d <= (1 + ratio) * reach)) & (held > 0))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column("vec_id").take(pa.array(rows)), b.column("v").take(pa.array(rows))], ["list", "vec_id", "v"])

    return queries.mapInArrow(run, "list int, vec_id bigint, v array<double>")


def _search(lists: DataFrame, looked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest in the lists that each query looks into."""
    schema = "query_id bigint, vec_id bigint, score double"
    # blocks: so many of each list's vectors and queries meet in one task
    parts = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTORS_A_BLOCK).cast("int").alias("vb"))
    asks = looked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_BLOCK).cast("int").alias("qb"))
    cut = materialise(parts.join(asks, "list"), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lists.join(small(cut), "list").select("list", F.pmod(F.xxhash64("vec_id"), "vb").cast("int").alias("b"), each("qb").alias("q"), "vec_id", "v")
    right = looked.join(small(cut), "list").select("list", each("vb").alias("b"), F.pmod(F.xxhash64("vec_id"), "qb").cast("int").alias("q"), "vec_id", "v")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            ids, x = np.asarray(a.column("vec_id").combine_chunks()), _matrix(a.column("v").combine_chunks())
            for query, q in zip(b.column("vec_id").to_pylist(), _matrix(b.column("v").combine_chunks()), strict=True):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                d[ids == query] = np.inf
                few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                few = few[np.isfinite(d[few])]
                few = few[np.lexsort((ids[few], d[few]))][:k]
                out[0].append(np.full(len(few), query, np.int64))
                out[1].append(ids[few])
                out[2].append(d[few])
        cols = [np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    ship(lists.sparkSession)
    near = left.groupBy("list", "b", "q").cogroup(right.groupBy("list", "b", "q")).applyInArrow(compare, schema)
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, ratio: float = 0.15, breadth: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found for each query, itself excepted: (query_id, rank from 1, vec_id, score = Euclidean distance). There are
    fewer than k only if the table has fewer other usable rows.

    ``queries`` are rows of the same shape as ``vectors``. See ``usable`` for rows that take no part; repeated vectors under other ids
    are candidates like any other, and ties go to the smaller id. Tables without usable rows give no result."""
    spark = vectors.sparkSession
    base = materialise(usable(vectors, id_col, vector_col), "vectors")
    graph = fit(base)
    if graph is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = base.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    lists = materialise(postings(base, graph), "postings")
    found = materialise(_search(lists, materialise(probes(asked, graph, ratio, breadth), "probes"), k), "found")
    want = min(k, base.count() - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= want).select(F.col("query_id").alias("vec_id"))
    short = materialise(asked.join(full, "vec_id", "left_anti"), "short") if want else None
    if short is None or not short.limit(1).count():
        return found
    sizes = np.zeros(len(graph.centroids), np.int64)
    for r in lists.groupBy("list").count().collect():  # MAX_LISTS rows at most
        sizes[r["list"]] = r["count"]
    more = _search(lists, materialise(wider(short, graph, ratio, sizes, want + 1), "more-probes"), k)
    kept = found.join(small(short.select(F.col("vec_id").alias("query_id"))), "query_id", "left_anti")
    return kept.select(*more.columns).union(more)
