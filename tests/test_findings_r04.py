"""Smoothing and palettes of many images: what is shuffled, and results held against the plain rules."""

import numpy as np
import pytest

from rasterloom.operators import marks, palette, palette_grid, smoothing


def rows_shuffled(df) -> int:
    """Rows that the exchanges of a frame write; it is run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            below = node.children()
            todo += [below.apply(k) for k in range(below.size())]
    return total


def upsampled(low, px, size, small, sigma, window=2):
    """The rule, pixel by pixel, over samples that may be missing."""
    out, h = {}, 1 + max(y for _, y in px)
    spread = 2 * (window / 1.5) ** 2
    for (x, y), v in px.items():
        cx, cy = (x + 0.5) * (small[0] / size) - 0.5, (y + 0.5) * (small[1] / h) - 0.5
        bx, by = (int(min(m - 1, max(0, np.floor(c + 0.5)))) for c, m in ((cx, small[0]), (cy, small[1])))
        near = [(ox, oy) for oy in range(by - window, by + window + 1) for ox in range(bx - window, bx + window + 1) if (ox, oy) in low]
        w = [np.exp(-((oy - cy) ** 2 + (ox - cx) ** 2) / spread) * np.exp(-((low[ox, oy] - v) ** 2).sum() / (2 * sigma**2)) for ox, oy in near]
        out[x, y] = sum(k * low[p] for k, p in zip(w, near, strict=True)) / sum(w) if sum(w) > 1e-12 else low[bx, by]
    return out


@pytest.fixture
def as_large(spark):
    """No table is small enough for a broadcast that isn't asked for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsampling_shuffles_pixels_and_not_their_taps(spark, as_large):
    rng, size, small = np.random.default_rng(5), 40, (16, 6)
    full = lambda h: {(x, y) for y in range(h) for x in range(size)}
    # whole, lower than the shrunk one, and with gaps: rows, columns, single pixels
    places = [full(15), full(3), {p for p in full(18) if not 5 <= p[1] <= 11 and not 10 <= p[0] <= 15 and rng.random() < 0.9} | {(0, 17)}]
    images = [{p: (rng.normal(size=2) * s).astype(np.float32).astype(float) for p in sorted(at)} for at, s in zip(places, (8, 8, 400), strict=True)]
    rows = [(n, y * size + x, x, y, *map(float, v)) for n, m in enumerate(images) for (x, y), v in m.items()]
    px = spark.createDataFrame(rows, "img bigint, i bigint, x int, y int, l float, a float").repartition(3)
    low = marks.box_means(px, ["l", "a"], size, small)
    samples = [{} for _ in images]
    for r in low.collect():
        samples[r.img][r.ox, r.oy] = np.array([r.l, r.a]).astype(np.float32).astype(float)
    for n, m in enumerate(images):
        h = 1 + max(y for _, y in m)
        boxes = {}
        for ox in range(small[0]):
            for oy in range(small[1]):
                held = [v for (x, y), v in m.items() if np.floor(ox * size / small[0]) <= x < np.ceil((ox + 1) * size / small[0]) and np.floor(oy * h / small[1]) <= y < np.ceil((oy + 1) * h / small[1])]
                if held:
                    boxes[ox, oy] = np.mean(held, 0)
        assert boxes.keys() == samples[n].keys() and all(np.allclose(samples[n][k], v, atol=1e-4) for k, v in boxes.items())
    assert len(samples[2]) < small[0] * small[1]
    out = smoothing.guided_upsample(low, px, ["l", "a"], (size, 0), small, 11.0)
    got = {(r.img, r.i): (r.l, r.a) for r in out.collect()}
    assert len(got) == len(rows)
    for n, m in enumerate(images):
        for (x, y), v in upsampled(samples[n], m, size, small, 11.0).items():
            assert np.allclose(got[n, y * size + x], v, atol=1e-3)
    shuffled = rows_shuffled(out)
    assert 0 < shuffled < 8 * len(rows), shuffled / len(rows)


def noisy(spark, monkeypatch):
    for m in (palette, palette_grid):
        monkeypatch.setattr(m, "MAX_ITERATIONS", 3)
    rng = np.random.default_rng(6)
    images = [rng.normal(size=(n, 3)).astype(np.float32) * 25 for n in (1500, 3, 700)] + [np.tile(np.float32([[1, 2, 3]]), (600, 1))]
    rows = [(n, i, *map(float, v)) for n, x in enumerate(images) for i, v in enumerate(x)]
    return images, spark.createDataFrame(rows, "img bigint, i bigint, l float, a float, b float").repartition(3)


def palettes(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.img, r.idx)):
        out.setdefault(r.img, []).append((r.l, r.a, r.b))
    return out


def test_palettes_store_their_samples_once(spark, monkeypatch):
    images, px = noisy(spark, monkeypatch)
    stored, written = palette.cut, []

    def counted(df, *label):
        out = stored(df, *label)
        written.append(out.count())
        return out

    monkeypatch.setattr(palette, "cut", counted)
    got = palettes(palette.kmeans(px, 5))
    for n, x in enumerate(images):
        assert np.allclose(got[n], palette_grid.kmeans(x, 5), atol=1e-3)
    n = sum(map(len, images))
    assert n < sum(written) < 1.2 * n, written  # with the weights of each draw: 5 n


def test_palettes_without_broadcasts(spark, monkeypatch, as_large):
    images, px = noisy(spark, monkeypatch)
    monkeypatch.setattr(palette, "SENT", 0)
    got = palettes(palette.kmeans(px, 5))
    for n, m in enumerate(images):
        assert np.allclose(got[n], palette_grid.kmeans(m, 5), atol=1e-3)
