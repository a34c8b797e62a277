"""Codes of vectors: each of a vector's equal parts is named by the nearest entry of its own codebook, in whole numbers throughout.

Rounds of k-means use bounds. For each part of each vector the table keeps its entry, an upper bound on the distance to that entry and a lower bound on the distance to
every other one, each with the round in which it was exact (its stamp). The history of codebooks is kept, so a bound is carried to the present by how far entries
are now from where they were at its stamp: the length of the sum of their moves, never more than the sum of the lengths that a
running bound would gather. Where the bounds can't tell, the upper one is made exact; where that doesn't help, all entries are looked at again.
Distances are exact whole numbers, bounds are rounded outwards, and only a strict gap settles an entry, so codes equal those of full scans.

The table of vectors with their bounds is written once a round; entries are sums that Spark aggregates, and codebooks (parts x entries x
width numbers, whatever the table's size) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


class Assigner:
    """Entries and bounds of batches of vectors under the latest codebook of a history of (parts, entries, width) arrays."""

    def __init__(self, history: Sequence[np.ndarray]):
        self.history, self.now = list(history), len(history) - 1
        self.rescans = 0
        #: By stamp: how far each entry is now from where it was, and of each entry how far the farthest other one is.
        self.moved = np.stack([np.sqrt(((self.history[-1] - h).astype(float) ** 2).sum(2)) for h in self.history])
        order = np.sort(self.moved, axis=2)
        top, second = order[:, :, -1:], order[:, :, -2:-1] if order.shape[2] > 1 else np.zeros_like(order)
        self.others = np.where(self.moved == top, np.where((self.moved == top).sum(2, keepdims=True) > 1, top, second), top)

    @staticmethod
    def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to entries, as int64."""
        big = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
        if 4 * x.shape[1] * int(big) ** 2 < 2**53:  # then doubles are exact too
            a, b = x.astype(float), entries.astype(float)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
        return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)

    def scan(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self.distances(x, entries)
        own = d.argmin(1)
        rows = np.arange(len(x))
        first = d[rows, own]
        d[rows, own] = np.iinfo(np.int64).max
        return own, np.sqrt(first.astype(float)), np.sqrt(d.min(1).astype(float)) if d.shape[1] > 1 else np.full(len(x), np.inf)

    def __call__(self, x: np.ndarray, state: tuple[np.ndarray, ...] | None):
        """``x``: (n, parts, width). State: entry, upper and lower bound, their stamps, each (n, parts)."""
        n, parts = x.shape[:2]
        if state is None:
            state = (np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8))
            unknown = np.ones((n, parts), bool)
        else:
            state = tuple(s.copy() for s in state)
            unknown = np.zeros((n, parts), bool)
        own, upper, lower, at_upper, at_lower = state
        for p in range(parts):
            entries, todo = self.history[-1][p], np.flatnonzero(unknown[:, p])
            if not len(todo):
                floor = lower[:, p] - self.others[at_lower[:, p], p, own[:, p]] * (1 + 1e-9)
                open_ = np.flatnonzero(~((upper[:, p] + self.moved[at_upper[:, p], p, own[:, p]]) * (1 + 1e-9) < floor))
                exact = np.sqrt(((x[open_, p] - entries[own[open_, p]]) ** 2).sum(1).astype(float))
                upper[open_, p], at_upper[open_, p] = exact, self.now
                todo = open_[~(exact * (1 + 1e-9) < floor[open_])]
                self.rescans += len(todo)
            if len(todo):
                own[todo, p], upper[todo, p], lower[todo, p] = self.scan(x[todo, p], entries)
                at_upper[todo, p] = at_lower[todo, p] = self.now
        return own, upper, lower, at_upper, at_lower


def _outwards(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as 32-bit floats that are no tighter."""
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.where(np.isinf(lower), lower, np.nextafter(lower.astype(np.float32), np.float32(-np.inf))).astype(np.float32)


def _pack(a: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(a).tobytes(), a.shape[1] * a.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def _unpack(c: pa.Array, kind, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), parts)


def _cells(c: pa.Array, parts: int) -> np.ndarray:
    return np.asarray(c.flatten(), np.int64).reshape(len(c), parts, -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, keep: Sequence[str], parts: int, scale: int) -> tuple[DataFrame, int]:
    """(id, kept, q) with q as whole numbers, and their length."""
    v = F.col(vector_col).cast("array<double>")
    fine = vectors.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept") if keep else F.struct(F.lit(None).cast("int").alias("none")).alias("kept"), v.alias("v")).where(
        f"v is not null and size(v) > 0 and size(v) % {parts} = 0 and forall(v, x -> x is not null and x = x and abs(x) < double('Infinity'))"
    )
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = lengths[0]["n"] if lengths else parts
    most = 1 << ((62 - width.bit_length()) // 2 - 1)
    q = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return fine.where((F.size("v") == width) & F.forall("v", lambda x: F.abs(x * scale) < most)).select("id", "kept", q.alias("q")), width


def _step(table: DataFrame, history: list[np.ndarray], first: bool) -> DataFrame:
    """The table with entries and bounds under the latest codebook."""
    from pyspark.sql.pandas.types import to_arrow_schema

    head = [table.schema[c] for c in ("id", "kept", "q")]
    schema = T.StructType([*head, *(T.StructField(c, T.BinaryType()) for c in ("code", "upper", "lower", "at_upper", "at_lower"))])
    arrow, parts = to_arrow_schema(schema), history[0].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(history)
        for b in batches:
            if not b.num_rows:
                continue
            kinds = (np.uint8, np.float32, np.float32, np.uint8, np.uint8)
            state = None if first else tuple(_unpack(b.column(3 + i), k, parts) for i, k in enumerate(kinds))
            if state:
                state = (state[0].astype(np.int64), state[1].astype(float), state[2].astype(float), *state[3:])
            own, upper, lower, at_upper, at_lower = assign(_cells(b.column(2), parts), state)
            upper, lower = _outwards(upper, lower)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(_pack(a) for a in (own.astype(np.uint8), upper, lower, at_upper, at_lower))], schema=arrow)

    return table.mapInArrow(run, schema)


def _means(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry as the componentwise floor of its parts' mean; unused entries stay. A task gives one row of sums for each entry it met."""
    parts, entries, width = book.shape
    names = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "entry", "n", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _cells(b.column(0), parts), _unpack(b.column(1), np.uint8, parts).astype(np.int64)
            for p in range(parts):
                np.add.at(total[p], own[:, p], x[:, p])
                count[p] += np.bincount(own[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (p, e, count[p, e], *total[p, e].T)], names=schema.names)

    sums = table.select("q", "code").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
    out = book.copy()
    for r in sums.collect():
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The table of usable vectors with entries and bounds under the last codebooks, and the history of codebooks (the first one, then one a round).

    Codebooks start with the ``entries`` smallest ids (nulls last; of equal ids the smaller vectors come first); fewer rows give fewer entries."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number takes one byte")
    ship(vectors.sparkSession)
    table, width = usable(vectors, id_col, vector_col, keep, parts, scale)
    start = [r["q"] for r in table.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()]
    history = [np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)]
    if not start:
        return _step(table, [np.zeros((parts, 1, width // parts), np.int64)], True), history
    for r in range(rounds):
        table = materialise(_step(table, history, r == 0), f"codes-{r}")
        history.append(_means(table, history[-1]))
    return _step(table, history, rounds == 0), history


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def decode(code: str, book: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middles of its entries' cells."""
    return (np.concatenate([book[p, e] for p, e in enumerate(bytes.fromhex(code))]) + 0.5) / scale


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **sizes) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks): for each usable row its code in hex, its squared error in whole numbers, and the errors of its
    label's rows summed.

    Rows whose vector is null or empty, holds a null or a non-finite component or isn't of the table's commonest length (a multiple of the parts) are
    left out, and so are those with components too large for exact 64-bit sums of squares (262,144 and more, of 64 components). Repeated rows
    and null ids are coded like others, rows without a label share one sum. An empty table gives no rows."""
    table, history = train(vectors, id_col, vector_col, (label_col,), **sizes)
    book = history[-1]
    parts = book.shape[0]
    schema = T.StructType([table.schema["id"], table.schema["kept"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _cells(b.column(2), parts), _unpack(b.column(3), np.uint8, parts)
            error = sum(((x[:, p] - book[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in own]), pa.array(error)], schema=arrow)

    coded = materialise(table.select("id", "kept", "q", "code").mapInArrow(run, schema).select("id", F.col("kept").getField(label_col).alias("label"), "code", "error"), "coded")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    out = coded.join(small(labels), F.col("label").eqNullSafe(F.col("l")), "left")
    return out.select(F.col("id").alias(id_col), "label", "code", "error", "label_error"), book
