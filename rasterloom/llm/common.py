"""What the corpus operators share: scratch tables, size-checked broadcasts, row keys and word splitting.

Every helper keeps work on the executors. Scratch tables go to ``spark.checkpoint.dir`` so that a lost executor
never takes the only copy of an intermediate result with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_folder as scratch_dir
from ..shipping import ship
from ..shipping import stored as materialise

__all__ = ["BROADCAST_ROWS", "ascii_lower", "columns", "fresh", "materialise", "row_key", "scratch_dir", "ship", "slices", "small", "table"]

#: A side is broadcast only if its counted rows stay at or below this many (rows of a few dozen bytes: tens of MB).
BROADCAST_ROWS = 400_000


def columns(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in names]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``rows`` rows, else as it is (Spark then shuffles both sides).

    ``df`` should be cheap to count: a written table or an aggregate of one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, that hold about ``size`` bytes of a text column each, one row at least: what a task holds as
    Python objects at a time then depends neither on the batch's rows nor on their lengths, but for a single longer text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 16)
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text: Column) -> Column:
    """A key for a row of (id, text) that is the same for repeated rows: (id, hash of the text, length).

    Repeated rows get equal results, so sharing a key is harmless; ids that are null or not unique are told apart
    by their text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster of two equal ways."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
