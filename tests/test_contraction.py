"""Merging of regions on relations against the rule gone through in order, image by image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import contraction, grid
from rasterloom.operators.merge import RegionGraph, merge_regions

PALETTE = [[20, 0, 0], [22, 1, 0], [40, 10, 0], [60, 0, 10], [66, 0, 12]]


@pytest.mark.parametrize(("delta", "foreground", "mean"), [(None, 2, 4), (30, None, 1)])
def test_merging_equals_the_rule_in_order(spark, delta, foreground, mean):
    rng = np.random.default_rng(mean)
    pixels, wanted, sizes, conf = [], {}, {}, {}
    for img in range(3):
        h, w = int(rng.integers(2, 4)), int(rng.integers(2, 5))
        idx = rng.integers(0, len(PALETTE), (h, w))
        label = grid.dense_rank(grid.components(idx, np.ones((h, w), bool)))
        pixels += [(img, y * w + x, x, y, int(label[y, x]), int(idx[y, x])) for y in range(h) for x in range(w)]
        n = label.max() + 1
        conf[img] = rng.choice([0.0, 0.25, 0.75], n)
        wanted[img] = merge_regions(RegionGraph.of(label, idx), mean / 2, mean * 1.5, conf[img], np.array(PALETTE, np.float32), delta, foreground)
    px = spark.createDataFrame(pixels, "img bigint, i bigint, x int, y int, label bigint, idx int").repartition(3)
    regions, links = contraction.region_graph(px, "label", "idx")
    known = spark.createDataFrame([(img, i, float(c)) for img, cs in conf.items() for i, c in enumerate(cs)], "img bigint, id bigint, conf double")
    full = regions.join(known, ["img", "id"]).withColumns({"least": mean / 2 + (1 - F.col("conf")) * (mean * 1.5 - mean / 2), "back": F.col("conf") < 0.5})
    got = contraction.merged(full, links, PALETTE, delta, foreground).collect()
    assert {img: [r.root for r in sorted((r for r in got if r.img == img), key=lambda r: r.id)] for img in wanted} == {img: w.tolist() for img, w in wanted.items()}
