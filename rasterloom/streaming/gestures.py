"""Pointer events as keyed state: taps, strokes, and the view's scale and place under pinching and panning.

One session's events go through a small machine in the order of their times. Its state (the pointers that are down, what the gesture began with, the view) is kept by Spark between
micro-batches, one string for each session, and freed by a timer when a session is idle; an event that comes later than that starts anew, so results don't depend on when
timers fire.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import shared_folder, ship
from .progress import EVENTS

# Limits of a tap and of the scale.
TAP_PIXELS, TAP_MS, LEAST_SCALE, MOST_SCALE = 10.0, 500, 1.0, 8.0
OUT = "session bigint, event_id bigint, what string, began bigint, scale double, tx double, ty double"
#: What an event of the table stands for.
KINDS = {"click": "down", "signup": "down", "view": "move", "purchase": "up", "error": "cancel"}


@dataclass
class Machine:
    """State of a session. ``pointers`` are (id, x, y) in the order in which they came down."""

    last: int | None = None
    pointers: list = field(default_factory=list)
    tap: list | None = None  # x, y, time, event
    pan: list | None = None
    pinch: list | None = None  # distance and middle
    scale: float = 1.0
    tx: float = 0.0
    ty: float = 0.0
    stroke: list | None = None  # pointer, first event
    pinching: bool = False

    def step(self, event: int, at: int, kind: str, pointer: int, x: float, y: float, tap_pixels: float, tap_ms: int) -> list[tuple]:
        """What an event brings about: (what, first event, scale, tx, ty)."""
        out: list[tuple] = []
        told = lambda what, began: out.append((what, began, self.scale, self.tx, self.ty))
        known = any(p[0] == pointer for p in self.pointers)
        if kind in ("up", "cancel"):
            self.pointers = [p for p in self.pointers if p[0] != pointer]
        elif known:
            self.pointers = [[pointer, x, y] if p[0] == pointer else p for p in self.pointers]
        elif kind == "down":
            self.pointers = [*self.pointers, [pointer, x, y]]
        n = len(self.pointers)
        if kind == "down":
            self.tap, self.pan = ([x, y, at, event], [x, y]) if n == 1 else (None, None)
            if n > 1:
                self.pinch = self._pinch() if n == 2 else None
            if self.stroke is None and not self.pinching and n == 1:
                self.stroke = [pointer, event]
            elif n == 2:
                if self.stroke:
                    told("stroke", self.stroke[1])
                self.stroke, self.pinching = None, True
        elif kind == "move":
            if known and n == 2 and self.pinch:
                (d0, mx0, my0), (d, mx, my) = self.pinch, self._pinch()
                if d0 > 0 and d > 0:
                    scale = min(MOST_SCALE, max(LEAST_SCALE, self.scale * (d / d0)))
                    by = scale / self.scale
                    self.scale, self.tx, self.ty = scale, mx - (mx - self.tx) * by + (mx - mx0), my - (my - self.ty) * by + (my - my0)
                    told("pinch", None)
                self.pinch = [d, mx, my]
            elif known and n == 1 and self.scale > 1 and self.pan:
                self.tx, self.ty = self.tx + x - self.pan[0], self.ty + y - self.pan[1]
                self.pan = [x, y]
                told("pan", None)
        else:
            self.pinch = None
            if n == 1:
                self.pan = self.pointers[0][1:]
            else:
                start, self.pan, self.tap = self.tap, None, None
                if start and kind == "up" and math.sqrt((x - start[0]) ** 2 + (y - start[1]) ** 2) <= tap_pixels and at - start[2] <= tap_ms:
                    told("tap", start[3])
            if self.stroke and self.stroke[0] == pointer:
                told("stroke", self.stroke[1])
                self.stroke = None
            elif self.pinching and n < 2:
                self.pinching = False
        return out

    def _pinch(self) -> list[float]:
        (_, ax, ay), (_, bx, by) = self.pointers
        return [math.sqrt((ax - bx) ** 2 + (ay - by) ** 2), (ax + bx) / 2, (ay + by) / 2]


def pointer_events(events: DataFrame, pointers: int = 3) -> DataFrame:
    """(session, event_id, ts, ms, kind, pointer, x, y) from the table of events; what has no kind or place is no pointer event."""
    kind = F.coalesce(*(F.when(F.col("event_type") == t, k) for t, k in KINDS.items()))
    out = events.select(
        F.col("user_id").alias("session"), "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("ms"), kind.alias("kind"),
        (F.col("event_id") % pointers).alias("pointer"), F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y"),
    )
    return out.where("session is not null and event_id is not null and ts is not null and kind is not null and x is not null and y is not null")


def run_machine(key: tuple, rows: pd.DataFrame, machine: Machine, idle_ms: int, tap_pixels: float, tap_ms: int) -> tuple[Machine, pd.DataFrame]:
    """The machine after a batch's rows of one session, and what they brought about."""
    out: list[tuple] = []
    for r in rows.sort_values(["ms", "event_id"]).itertuples(index=False):
        if machine.last is not None and r.ms - machine.last > idle_ms:
            machine = Machine()
        machine.last = int(r.ms)
        out += [(key[0], r.event_id, *o) for o in machine.step(int(r.event_id), int(r.ms), r.kind, int(r.pointer), float(r.x), float(r.y), tap_pixels, tap_ms)]
    table = pd.DataFrame(out, columns=["session", "event_id", "what", "began", "scale", "tx", "ty"])
    return machine, table.astype({"began": "Int64"})


def stream_gestures(spark: SparkSession, folder: str, pattern: str = "events.parquet", out: str | None = None, idle_ms: int = 30_000, tap_pixels: float = TAP_PIXELS, tap_ms: int = TAP_MS, files_a_trigger: int = 1) -> DataFrame:
    """(session, event_id, what, began, scale, tx, ty): taps, strokes (with the event they began with), pinches and pans, and the view after each, once all events of a folder have been read as
    a stream. Called again with the same ``out`` it goes on from its checkpoint. A session's events of one micro-batch are put in order by time in memory;
    events of a later batch are taken as they come."""
    ship(spark)
    base = out or f"{shared_folder(spark)}/gestures-{uuid.uuid4().hex}"
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    moves = pointer_events(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = Machine(**json.loads(state.get[0])) if state.exists else Machine()
        machine, told = run_machine(key, pd.concat(parts), machine, idle_ms, tap_pixels, tap_ms)
        state.update((json.dumps(asdict(machine)),))
        state.setTimeoutTimestamp(max(machine.last + idle_ms, state.getCurrentWatermarkMs()) + 1)
        if len(told):
            yield told

    told = moves.groupBy("session").applyInPandasWithState(advance, OUT, "machine string", "append", GroupStateTimeout.EventTimeTimeout)
    q = told.writeStream.format("parquet").option("checkpointLocation", f"{base}/offsets").outputMode("append").trigger(availableNow=True).start(f"{base}/told")
    q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/told")
