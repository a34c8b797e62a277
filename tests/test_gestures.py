"""Gestures: single machines by hand, and the stream over restarts."""

import pytest

from rasterloom.streaming.gestures import Machine, stream_gestures


def played(events):
    m, out = Machine(), []
    for n, (at, kind, pointer, x, y) in enumerate(events):
        out += [(n, what, began) for what, began, *_ in m.step(n, at, kind, pointer, x, y, 10.0, 500)]
    return m, out


def test_taps_and_strokes():
    assert played([(0, "down", 1, 5, 5), (100, "up", 1, 8, 9)])[1] == [(1, "tap", 0), (1, "stroke", 0)]
    assert played([(0, "down", 1, 5, 5), (501, "up", 1, 5, 5)])[1] == [(1, "stroke", 0)]  # too long
    assert played([(0, "down", 1, 5, 5), (9, "up", 1, 16, 5)])[1] == [(1, "stroke", 0)]  # too far
    assert played([(0, "down", 1, 5, 5), (9, "cancel", 1, 5, 5)])[1] == [(1, "stroke", 0)]
    assert played([(0, "up", 1, 5, 5), (1, "move", 1, 5, 5)])[1] == []


def test_a_second_finger_closes_the_stroke_and_pinches():
    m, out = played([(0, "down", 1, 0, 0), (1, "down", 2, 10, 0), (2, "move", 2, 20, 0), (3, "up", 2, 20, 0), (4, "move", 1, 3, 4), (5, "up", 1, 3, 4)])
    assert out == [(1, "stroke", 0), (2, "pinch", None), (4, "pan", None)]
    assert (m.scale, m.tx, m.ty) == (2, 10 - (10 - 0) * 2 + (10 - 5) + 3, 4)  # about the middle, then with it; then one finger pans
    m, _ = played([(0, "down", 1, 0, 0), (1, "down", 2, 1, 0), (2, "move", 2, 100, 0), (3, "move", 2, 1, 0)])
    assert m.scale == 1  # 8 at most, then 8 / 100 of it, 1 at least


@pytest.mark.parametrize("parts", [1, 2])
def test_the_stream_goes_on_where_it_stopped(spark, data, tmp_path, parts):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    folder, out = f"{tmp_path}/events", f"file://{tmp_path}/out"
    limits = {"idle_ms": 4 * 86_400_000, "tap_pixels": 60.0, "tap_ms": 86_400_000}
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(stream_gestures(spark, data, **limits))
    half = events.orderBy("ts").collect()[events.count() // 2]["ts"]
    events.where(f"ts <= timestamp_ntz'{half}'" if parts == 2 else "true").coalesce(1).write.mode("append").parquet(folder)
    first = key(stream_gestures(spark, folder, "*.parquet", out=out, **limits))
    assert first == key(stream_gestures(spark, folder, "*.parquet", out=out, **limits))
    if parts == 2:
        events.where(f"ts > timestamp_ntz'{half}'").coalesce(1).write.mode("append").parquet(folder)
        assert len(first) < len(whole)
    assert key(stream_gestures(spark, folder, "*.parquet", out=out, **limits)) == whole and whole
