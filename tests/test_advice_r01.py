"""Queries over whole columns and tables, against values made without SQL."""

import base64
import math

import pytest

from rasterloom import registry


def test_data_url_holds_the_whole_value(spark, tmp_path):
    rows = [(1, "x"), (2, "https://example.com/" + "abc/" * 60), (3, "ü" * 41), (4, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.url for r in registry.queries()["s13_data_url"](spark, str(tmp_path)).collect()}
    assert got == {i: u and "data:image/png;base64," + base64.b64encode(u.encode()).decode() for i, u in rows}


def test_spatial_kernel_of_every_part(spark, tmp_path):
    rows = [(1, 7), (2, 1), (3, 50), (4, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.p_partkey, r.dx, r.dy): r.w for r in registry.queries()["p20_spatial_kernel"](spark, str(tmp_path)).collect()}
    want = {(i, x, y): math.exp(-(x * x + y * y) / (2 * (4 / 1.5) ** 2)) for i, _ in rows for x in range(-4, 5) for y in range(-4, 5)}
    assert got == pytest.approx(want, abs=1e-5)
