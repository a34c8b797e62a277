"""Groups of rows folded in order, however large a group is.

Rows are dealt by ranges of (group, order), so that a group that holds a third of all rows is spread over many tasks, and each task reads
its rows in order as a stream. A group that lies inside one task is folded there. Of a group that goes on in another task, or
is longer than ``HELD`` segments, the task gives summaries of segments of bounded size; these meet by group in a second, much smaller
exchange, and are added one after the other. Neither step holds more than a few segments at a time, besides what the fold's own state keeps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship, slices

HELD = 64


class Fold:
    """What ``fold_groups`` needs: how a group's rows, cut into segments, become one row.

    ``rows`` are tuples of the columns given to ``fold_groups``. Summaries and states are any picklable values."""

    #: A segment ends at so many rows or characters of its last column.
    rows, chars = 32, 1 << 21
    #: Fields of the result, as Spark's DDL.
    fields = ""

    def segment(self, rows: list[tuple], before: tuple | None, whole: bool):
        """Summary of consecutive rows. ``before``: the row ahead of them, where the task has it. ``whole``: they are the whole group."""
        raise NotImplementedError

    def start(self):
        raise NotImplementedError

    def add(self, state, summary):
        raise NotImplementedError

    def finish(self, state) -> tuple:
        raise NotImplementedError

    def of(self, summaries) -> tuple:
        state = self.start()
        for s in summaries:
            state = self.add(state, s)
        return self.finish(state)


def _segments(fold: Fold, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(group, (rows, the row before them), whether the group ends with them)."""
    group, rows, size, some, before = None, [], 0, False, None
    for batch in batches:
        for part in slices(batch, batch.schema.names[-1]):
            for g, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if some and g != group:
                    yield group, (rows, before), True
                    rows, size, before = [], 0, None
                elif len(rows) >= fold.rows or size >= fold.chars:
                    yield group, (rows, before), False
                    rows, size, before = [], 0, rows[-1]
                group, some = g, True
                rows.append(tuple(row))
                size += len(row[-1] or "")
    if some:
        yield group, (rows, before), True


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(v) for v in r if isinstance(v, str | bytes))
        if size >= limit or len(held) >= 4096:
            yield _table(held, schema)
            held, size = [], 0
    if held:
        yield _table(held, schema)


def fold_groups(rows: DataFrame, group: str, ranges: list[str | Column], order: list[str | Column], fold: Fold, columns: list[str]) -> DataFrame:
    """(group, *fold.fields): one row for each value of ``group``, null among them.

    ``ranges``: expressions (after the group) that deal out the rows, narrow, and such that ``order`` never contradicts them. ``columns``: what
    the fold sees of each row; the last one is its text. Rows that are equal in ``order`` may come in any order."""
    spark = rows.sparkSession
    ship(spark)
    dealt = rows.repartitionByRange(F.col(group).asc_nulls_first(), *ranges).sortWithinPartitions(F.col(group).asc_nulls_first(), *order).select(group, *columns)
    kind = rows.schema[group].dataType
    fields = T.StructType.fromDDL(fold.fields)
    out = T.StructType([T.StructField(group, kind), T.StructField("_part", T.IntegerType()), T.StructField("_no", T.LongType()), T.StructField("_summary", T.BinaryType()), *fields.fields])
    last = T.StructType([T.StructField(group, kind), *fields.fields])
    empty = (None,) * len(fields)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, no, first = TaskContext.get().partitionId(), 0, True
        held: list = []  # segments of a group of which the end isn't known yet
        waits = None  # the last group, complete in this task as far as can be seen
        for g, seg, ended in _segments(fold, batches):
            if waits is not None:
                one = len(waits[1]) == 1
                yield (waits[0], None, None, None, *fold.of(fold.segment(*s, one) for s in waits[1]))
                waits = None
            held.append(seg)
            if first or len(held) > HELD:  # goes on from the task before, or is long
                for s in held:
                    yield (g, part, no, pickle.dumps(fold.segment(*s, False), 5), *empty)
                    no += 1
                held = []
                first = True
            if ended:
                if held:
                    waits = (g, held)
                held, first = [], False
        if waits is not None:
            for s in waits[1]:
                yield (waits[0], part, no, pickle.dumps(fold.segment(*s, False), 5), *empty)
                no += 1

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group_now, state, some = None, None, False
        for batch in batches:
            for i in range(batch.num_rows):
                g, summary = batch.column(0)[i].as_py(), pickle.loads(batch.column(1)[i].as_py())
                if some and g != group_now:
                    yield (group_now, *fold.finish(state))
                    some = False
                if not some:
                    group_now, state, some = g, fold.start(), True
                state = fold.add(state, summary)
        if some:
            yield (group_now, *fold.finish(state))

    from pyspark.sql.pandas.types import to_arrow_schema

    a_out, a_last = to_arrow_schema(out), to_arrow_schema(last)
    done = materialise(dealt.mapInArrow(lambda b: _in_batches(within(b), a_out), out), "folds")
    rest = done.where("_no is not null").select(group, "_summary", "_part", "_no").repartition(group).sortWithinPartitions(group, "_part", "_no").select(group, "_summary")
    return done.where("_no is null").select(*last.names).union(rest.mapInArrow(lambda b: _in_batches(across(b), a_last), last))
