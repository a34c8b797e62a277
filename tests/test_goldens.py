"""Hand-derived results of single operators, and properties of whole segmentations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.fixtures import ORD, r_ord
from rasterloom.functions import color, text
from rasterloom.operators import edges, grid
from rasterloom.operators import regions as R
from rasterloom.operators.merge import RegionGraph
from rasterloom.operators.palette_grid import Random32, kmeans
from rasterloom.plans import segment
from rasterloom.sources import rasters

from . import plain_contours as contour


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def raster(spark, rows):
    return spark.createDataFrame([(0, y * len(r) + x, x, y, v) for y, r in enumerate(rows) for x, v in enumerate(r)], "img bigint, i bigint, x int, y int, v int")


def test_lab(spark):
    for rgb, want in (((255, 0, 0), (53.2408, 80.0925, 67.2032)), ((0, 255, 0), (87.7347, -86.1827, 83.1793)), ((0, 0, 255), (32.2970, 79.1875, -107.8602)), ((128, 128, 128), (53.5850, 0, 0))):
        got = one(spark, color.lab(*map(F.lit, rgb)))
        assert np.allclose([got.l, got.a, got.b], want, atol=2e-4)


def test_names(spark):
    for f, want in (("Foo  Bar_2.JPG", "foo-bar-2"), ("Été.png", "t")):
        assert one(spark, text.slugify(F.lit(f))) == want
    assert one(spark, text.default_name(F.lit("my_cat-photo.jpg"))) == "My Cat Photo"
    assert one(spark, text.default_name(F.lit(".jpg"))) == "My Picture"
    assert one(spark, text.group_key(F.lit("a-easy-hard"))) == "a-easy"
    assert [one(spark, color.round_half_up(F.lit(v))) for v in (-2.5, 2.5)] == [-2, 3]


def test_runs(spark):
    px = raster(spark, [[1, 1, 2], [2, 2, 1]])
    enc = R.encode_runs(px, "v")
    assert enc.first()["runs"] == [1, 2, 2, 3, 1, 1]
    assert {(r.i, r.value) for r in R.decode_runs(enc).collect()} == {(r.i, r.v) for r in px.collect()}


def test_components_and_adjacency(spark):
    rows = [[0, 0, 1], [1, 0, 1], [1, 1, 0]]
    label = grid.dense_rank(grid.components(np.array(rows), np.ones((3, 3), bool)))
    assert label.tolist() == [[0, 0, 1], [2, 0, 1], [2, 2, 3]]
    px = raster(spark, label.tolist())
    assert {(r.a, r.b): r.border for r in R.adjacency(px, "v").collect() if r.a < r.b} == {(0, 1): 2, (0, 2): 3, (1, 3): 1, (2, 3): 1}
    g = RegionGraph.of(label, np.array(rows))
    assert g.area.tolist() == [3, 2, 3, 1] and g.links[0] == {1: 2, 2: 3}
    grown = {r.i: r.root for r in R.grow(raster(spark, rows), "v").collect()}
    assert grown == {0: 0, 1: 0, 4: 0, 2: 2, 5: 2, 3: 3, 6: 3, 7: 3, 8: 8}


def test_mode_filter():
    assert grid.mode_filter(np.array([[0, 1, 0, 1, 1]]), 1, 1).tolist() == [[0, 0, 1, 1, 1]]


def test_percentile_and_downscale():
    assert edges.percentile(np.arange(1, 21), 0.95) == 20
    assert grid.downscale(np.array([[[0.0], [3.0], [6.0]]], np.float32), 2, 1).ravel().tolist() == [1.5, 4.5]


def test_random_numbers():
    draw = Random32()
    assert [draw() for _ in range(3)] == [0.3588899802416563, 0.10590326134115458, 0.675290479324758]


def test_corner_cutting_keeps_a_square():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert contour.cut_corners(square, 2) == square


def test_budget_and_areas():
    assert [segment.budget(k) for k in (8, 14, 24)] == [(5, 3), (9, 5), (16, 8)]
    assert segment.TIERS["easy"].areas(640 * 480)[0] == pytest.approx(1228.8)


def test_label_point(spark):
    px = spark.createDataFrame([(0, 0, 0, 3, 1), (0, 1, 3, 1, 1)], "img bigint, i bigint, x int, y int, v int")
    ring = R.label_points(px, "v").first()
    assert (ring.label_x, ring.label_y) in {(0, 3), (3, 1)}


def test_palette_is_seeded():
    x = np.random.default_rng(3).normal(size=(500, 3)).astype(np.float32) * 20
    assert (kmeans(x, 6) == kmeans(x, 6)).all() and len(kmeans(x, 6)) <= 6
    assert len(kmeans(x[:0], 6)) == 0 and len(kmeans(np.repeat(x[:1], 9, 0), 4)) == 1


def test_segmentation_properties(spark, data):
    got = segment.segment_labels(r_ord(spark, data), ORD, "easy", min_area=(0.004, 20), background_area=(0.012, 60)).toPandas()
    again = segment.segment_labels(r_ord(spark, data).repartition(7), ORD, "easy", min_area=(0.004, 20), background_area=(0.012, 60)).toPandas()
    key = ["img", "i"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    for _, image in got.groupby("img"):
        h = image["y"].max() + 1
        label = image.sort_values("i")["region_id"].to_numpy().reshape(h, ORD[0])
        assert sorted(np.unique(label)) == list(range(1, label.max() + 1))
        first = [np.flatnonzero(label.ravel() == k)[0] for k in range(1, label.max() + 1)]
        assert first == sorted(first)
        parts = grid.components(label, np.ones(label.shape, bool))
        assert len(np.unique(parts)) == label.max()  # each region hangs together


def test_disc_survives_segmentation(spark):
    i = F.col("id")
    x, y = i % 96, F.floor(i / 96)
    disc = (x - 32) * (x - 32) + (y - 32) * (y - 32) <= 400
    px = spark.range(96 * 64).select(F.lit(0).cast("bigint").alias("img"), i.alias("i"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.when(disc, 200).otherwise(40).alias("r"), F.when(disc, 60).otherwise(80 + x).cast("int").alias("g"), F.when(disc, 40).otherwise(160).alias("b"), F.when(disc, 255).otherwise(0).alias("conf"))
    got = segment.segment_labels(px, (96, 64), "easy", min_area=(0.004, 40), background_area=(0.012, 100)).where("x between 22 and 42 and y between 22 and 42")
    assert got.select("region_id").distinct().count() == 1
    assert segment.outline_pixels(px, (96, 64)).count() > 0


def test_morphology(spark):
    m = np.zeros((7, 7), bool)
    m[3, 3] = True
    assert edges.dilate_disc(m, 1).sum() == 5 and edges.dilate_disc(m, 0) is m
    px = spark.createDataFrame([(0, 3, 3)], "img bigint, x int, y int")
    frame = spark.createDataFrame([(0, 6, 6)], "img bigint, right int, bottom int")
    assert R.dilate(px, 2, frame).count() == edges.dilate_disc(m, 2).sum()


def test_ppm_round_trip(spark):
    px = spark.createDataFrame([("a", i, i % 3, i // 3, i * 20, 255 - i, 7) for i in range(6)], rasters.PIXELS)
    back = rasters.decode(rasters.encode(px))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
    assert rasters.parse(b"no image") is None


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/manifest.json"
    assert rasters.read_manifest(spark, path).count() == 0
    row = spark.createDataFrame([("b", "B"), ("a", "A")], "id string, name string")
    rasters.write_manifest(row, path)
    assert [r.id for r in rasters.read_manifest(spark, path).orderBy("id").collect()] == ["a", "b"]
