"""Vector codes against full scans, and rows of every odd kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import vectorcodes as V

TABLE = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale=256):
    """Codes by looking at every entry in every round, with Python's whole numbers."""
    fine = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    q = [[math.floor(float(np.float32(x)) * scale) for x in r[1]] for r in fine]
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, q[i]))[:entries]
    w = len(q[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(q[i], p) for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in q]
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, o in zip(q, own, strict=True) if o[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    errors = [sum(d for d, _ in o) for o in own]
    total = {}
    for r, e in zip(fine, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in o), e, total[r[2]]) for r, o, e in zip(fine, own, errors, strict=True)), books


@pytest.mark.parametrize(("n", "entries", "rounds", "spread"), [(300, 64, 2, 1.0), (200, 5, 6, 0.02), (3, 64, 2, 1.0), (150, 16, 4, 800.0)])
def test_codes_equal_full_scans(spark, n, entries, rounds, spread):
    rng = np.random.default_rng(n)
    middles = rng.normal(0, spread, (8, 32))
    vectors = [[float(x) for x in (middles[i % 8] + rng.normal(0, spread / 8, 32)).astype(np.float32)] for i in range(n)]
    rows = [(i, v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors)]
    rows += [rows[0], (None, vectors[1], 1), (n + 1, None, 1), (n + 2, [], 1), (n + 3, [None, *vectors[0][1:]], 1), (n + 4, [float("nan"), *vectors[0][1:]], 2), (n + 5, [float("inf"), *vectors[0][1:]], 2), (n + 6, vectors[2][:16] * 2, None)]
    df = spark.createDataFrame(rows, TABLE).repartition(3).withColumns({c: F.lit(1) for c in ("id", "kept", "q", "code", "error", "l", "v", "n")})
    out, book = V.encode_vectors(df, entries=entries, rounds=rounds)
    want, books = plain(rows, 16, entries, rounds)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out.collect()) == want
    assert book.tolist() == books and V.digest(book) == V.digest(np.array(books))
    errors = {r.code: r.error for r in out.collect()}
    code = out.first().code
    assert V.decode(code, book).shape == (32,) and errors[code] >= 0


def test_lengths_that_differ_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [2.0] * 16, 1), (3, [3.0] * 32, 1), (4, [1.0] * 15, 1), (5, [1e30] * 16, 1)], TABLE)
    out, book = V.encode_vectors(df)
    assert sorted(r.vec_id for r in out.collect()) == [1, 2] and book.shape == (16, 2, 1)
    none, book = V.encode_vectors(df.where("false"))
    assert none.count() == 0 and book.size == 0


def test_stamped_bounds_spare_scans_and_are_tighter_than_gathered_drift():
    rng = np.random.default_rng(1)
    x = rng.integers(-3000, 3000, (4000, 2, 4))
    history = [rng.integers(-3000, 3000, (2, 32, 4))]
    state, spared = None, 0
    for r in range(8):
        assign = V.Assigner(history)
        state = assign(x, state)
        full = V.Assigner(history)(x, None)
        assert (state[0] == full[0]).all()
        if r:
            assert assign.rescans < x.shape[0] * x.shape[1]
            spared += x.shape[0] * x.shape[1] - assign.rescans
            steps = sum(np.sqrt(((b - a).astype(float) ** 2).sum(2)) for a, b in zip(history, history[1:], strict=False))
            assert (assign.moved[0] <= steps + 1e-9).all()
        step = rng.integers(-60, 60, history[0].shape) * (1 if r % 2 else -1)
        history.append(history[-1] + step)
    assert spared > 4000
