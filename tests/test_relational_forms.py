"""Relations against the rules they stand for, image by image; the fill stream over restarts; raster files as a source and sink."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import borders, grid, palette, palette_grid, turning
from rasterloom.operators import regions as R
from rasterloom.sources import raster_source, rasters
from rasterloom.streaming import progress

from . import plain_contours as contour


def loops_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.img, r.loop, r.k)):
        out.setdefault((r.img, r.loop), []).append((float(r.x), float(r.y)))
    return out


def test_contours_equal_the_rules(spark):
    rng = np.random.default_rng(8)
    masks = [rng.random((9, 12)) < p for p in (0.35, 0.65, 0.85)]
    ring = np.zeros((11, 11), bool)
    ring[1:10, 1:10] = True
    ring[3:8, 3:8] = False
    ring[5, 5] = True  # an island in a hole
    masks += [ring, np.ones((1, 1), bool), np.zeros((3, 2), bool)]
    rows = [(n, y * m.shape[1] + x, x, y, int(m[y, x])) for n, m in enumerate(masks) for y in range(m.shape[0]) for x in range(m.shape[1])]
    px = borders.components(spark.createDataFrame(rows, "img bigint, i bigint, x int, y int, v int").repartition(3), "v")
    chosen = borders.loops(px, "v", 1)
    order = borders.border_order(px, chosen)
    want = {(n, k): [tuple(map(float, p)) for p in loop] for n, m in enumerate(masks) for k, loop in enumerate(contour.contours(m.astype(np.uint8), 1))}
    assert loops_of(order) == want
    kept = borders.simplified(order, 1.0)
    simple = {k: contour.simplify(loop, 1.0) for k, loop in want.items()}
    assert loops_of(kept) == {k: [tuple(map(float, p)) for p in loop] for k, loop in simple.items()}
    cut = loops_of(borders.corners_cut(kept, 2))
    assert cut.keys() == simple.keys()
    for k, loop in simple.items():
        assert np.allclose(cut[k], contour.cut_corners(loop, 2))
    held = {(r.img, r.root): r.inside for r in chosen.where("hole").collect()}
    assert held[3, 3 * 11 + 3] == 11 + 1


def test_palettes_equal_the_rule(spark):
    rng = np.random.default_rng(4)
    images = [rng.normal(size=(700, 3)) * 25, np.tile([[1.0, 2, 3]], (600, 1)), rng.normal(size=(5, 3)), np.repeat(rng.normal(size=(3, 3)) * 40, 400, 0)]
    rows = [(n, 3 * i, *map(float, v)) for n, x in enumerate(images) for i, v in enumerate(x.astype(np.float32))]
    px = spark.createDataFrame(rows, "img bigint, i bigint, l float, a float, b float").repartition(4)
    got = {}
    for r in sorted(palette.kmeans(px, 6).collect(), key=lambda r: (r.img, r.idx)):
        got.setdefault(r.img, []).append((r.l, r.a, r.b))
    for n, x in enumerate(images):
        want = palette_grid.kmeans(x.astype(np.float32), 6)
        assert np.allclose(np.array(got[n]), want, atol=1e-3) and len(got[n]) == len(want)
    strided = palette.samples(px, limit=200).groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("said"), F.max("j").alias("j")).collect()
    assert {r.img: r.n for r in strided} == {n: len(x[:: max(1, len(x) // 200)]) for n, x in enumerate(images)} and all(r.n == r.said == r.j + 1 for r in strided)


def test_turning_upright(spark):
    px = spark.createDataFrame([(0, x, y, 10 * y + x) for y in range(2) for x in range(3)], "img bigint, x int, y int, v int")
    turned = lambda o: {(r.x, r.y): r.v for r in turning.turned(px, F.lit(o)).collect()}
    grid = np.array([[0, 1, 2], [10, 11, 12]])
    for o, want in {1: grid, 2: grid[:, ::-1], 3: grid[::-1, ::-1], 4: grid[::-1], 5: grid.T, 6: np.rot90(grid, -1), 7: grid[::-1, ::-1].T, 8: np.rot90(grid)}.items():
        assert turned(o) == {(x, y): int(v) for (y, x), v in np.ndenumerate(want)}, o
    same = turning.fit_inside(px, 5, ["v"]).collect()
    assert {(r.x, r.y): r.v for r in same} == {(x, y): float(10 * y + x) for y in range(2) for x in range(3)}


def test_fill_stream_goes_on_where_it_stopped(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    folder, out = f"{tmp_path}/events", f"file://{tmp_path}/out"
    half = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    key = lambda df: sorted(map(tuple, df.select("puzzle", "region", "fill").collect()))
    fold = lambda df: key(progress.upsert(None, progress.accepted(progress.taps(df)).select("puzzle", "region", F.struct("ts", "event_id").alias("ord"), "fill"), ["puzzle", "region"], "ord"))
    run = lambda: key(progress.stream_fills(spark, folder, "*.parquet", out=out))
    (tmp_path / "events").mkdir()
    assert run() == []
    events.where(f"event_id <= {half}").coalesce(1).write.mode("append").parquet(folder)
    first = run()
    assert first == fold(events.where(f"event_id <= {half}")) and first
    assert run() == first  # no new files
    events.where(f"event_id > {half}").coalesce(1).write.mode("append").parquet(folder)
    assert run() == fold(events) and run() == fold(events)


def test_raster_files(spark, tmp_path):
    raster_source.register(spark)
    folder = f"{tmp_path}/rasters"
    px = spark.createDataFrame([(s, i, i % w, i // w, (i * 7 + k) % 256, 255 - i % 256, 3) for k, (s, w, n) in enumerate((("a", 3, 12), ("b", 40, 2000), ("c", 1, 1))) for i in range(n)], rasters.PIXELS).repartition(5)
    raster_source.in_file_order(px).write.format("raster").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "rasters").iterdir()) == ["a.ppm", "b.ppm", "c.ppm"]
    back = spark.read.format("raster").load(folder)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
    raster_source.in_file_order(px.where("slug <> 'b'")).write.format("raster").mode("overwrite").save(folder)
    assert sorted(p.name for p in (tmp_path / "rasters").iterdir()) == ["a.ppm", "c.ppm"]
    broken = px.union(spark.createDataFrame([("z", 0, None, 0, 1, 1, 1)], rasters.PIXELS))
    with pytest.raises(Exception, match="(?i)task|abort|error"):
        raster_source.in_file_order(broken.withColumn("slug", F.concat(F.lit("new-"), "slug"))).write.format("raster").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "rasters").iterdir()) == ["a.ppm", "c.ppm"]  # nothing of the broken job is left


@pytest.mark.parametrize("eight", [False, True])
def test_components_of_sparse_masks_equal_the_rule(spark, eight):
    rng = np.random.default_rng(5)
    images = [np.where(rng.random((int(h), int(w))) < 0.75, rng.integers(0, 2, (int(h), int(w))), -1) for h, w in rng.integers(1, 14, (12, 2))]
    rows = [(n, y * m.shape[1] + x, x, y, int(m[y, x])) for n, m in enumerate(images) for y in range(m.shape[0]) for x in range(m.shape[1]) if m[y, x] >= 0]
    px = spark.createDataFrame(rows, "img bigint, i bigint, x int, y int, v int").repartition(3)
    got = {(r.img, r.i): r.root for r in R.grow(px, "v", eight).collect()}
    want = {}
    for n, m in enumerate(images):
        label = grid.components(m, m >= 0, grid.AROUND_8 if eight else grid.AROUND_4)
        want |= {(n, i): int(v) for i, v in enumerate(label.ravel()) if v >= 0}
    assert got == want
