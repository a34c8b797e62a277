"""Relations against the same rules written for one image or one list, and sources with odd files."""

import json

import numpy as np
from pyspark.sql import functions as F

from rasterloom import registry
from rasterloom.fixtures import ORD
from rasterloom.functions import random
from rasterloom.operators import edges
from rasterloom.operators import state as S
from rasterloom.operators.palette_grid import Random32
from rasterloom.plans.image_queries import lab_rows
from rasterloom.sources import rasters


def test_random_numbers(spark):
    for seed in (0, 1, 0x9E3779B9, 2**40 + 17):
        draw = Random32(seed)
        got = spark.range(50).select(random.random32(F.lit(seed), F.col("id")).alias("u"), "id").orderBy("id").collect()
        assert [r.u for r in got] == [draw() for _ in range(50)]


def test_feature_lines_of_whole_images(spark, data):
    got = {(r.img, r.i) for r in registry.queries()["c3_feature_lines"](spark, data).collect()}
    want = set()
    for img, px in lab_rows(spark, data).select("img", "x", "y", "l").toPandas().groupby("img"):
        if len(px) % ORD[0]:
            continue
        lum = np.zeros((px["y"].max() + 1, ORD[0]), np.float32)
        lum[px["y"], px["x"]] = px["l"]
        want |= {(img, int(i)) for i in np.flatnonzero(edges.feature_lines(lum, min_chain=3))}
    whole = {i for i, _ in want}
    assert want and {p for p in got if p[0] in whole} == want


def test_places_within_a_hot_key(spark):
    rows = [(None if k % 7 == 0 else 1 if k % 3 else k, k * 37 % 101, k) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v long, id long")
    got = {r.id: r.place for r in S.place_within(df, ["k"], [F.desc("v"), "id"], "place").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    assert S.place_within(df.limit(0), ["k"], ["v", "id"], "place").count() == 0


def test_manifest_of_one_array(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "width": 3, "regions": [{"id": 1}]}, {"id": "b"}, {"name": "no id"}], indent=1))
    got = rasters.read_manifest(spark, f"file://{tmp_path}/m.json", lines=False).orderBy("id").collect()
    assert [(r.id, r.width) for r in got] == [("a", 3), ("b", None)] and got[0].regions[0].id == 1


def test_json_value(spark):
    rows = [('{"k": 5}',), ('{"k": 5',), ("",), (None,), ('{"j": 1}',), ('{"k": "x"}',)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.k for r in df.select(rasters.json_value(F.col("t"), "$.k", "int").alias("k")).collect()] == [5, None, None, None, None, None]


def test_pam_file(spark):
    px = spark.createDataFrame([(0, i % 3, i // 3, i, 31, 255, 9) for i in range(6)], "img long, x int, y int, r int, g int, b int, a int")
    row = rasters.encode_pam(px).collect()[0]
    head, body = bytes(row.content).split(b"ENDHDR\n")
    assert b"WIDTH 3\nHEIGHT 2\nDEPTH 4" in head and list(body) == [v for i in range(6) for v in (i, 31, 255, 9)]
