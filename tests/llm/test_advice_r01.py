"""Rows that the operators once left out or could not treat."""

import collections

import numpy as np

import corpus_pipeline
from rasterloom.llm import ann, bpe, linedup, shards
from rasterloom.llm import queries as Q


def test_shards_of_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(0, "one two"), (0, "one two"), (0, "other " * 50), (1, "b"), (None, "no id"), (None, "no id"), (None, None), (None, ""), (2, None), (2, None), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op6_shards(spark, str(tmp_path)).count() == len(rows)
    enc = shards.RankEncoder(Q.RANK_FILE, bpe.SPLIT, end=50256)
    folder = f"file://{tmp_path}/out"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = shards.write_shards(docs, enc, folder, length=16, per_shard=4, strict=False).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    back = list(shards.read_slots(folder, 0, len(out), length=16, per_shard=4))
    got = collections.Counter((r.id, r.seq_no, tuple(back[r.slot][: r.n_tokens].tolist())) for r in out)
    want = collections.Counter()
    for i, t in rows:
        ids = enc([t or ""])[0].tolist()
        want.update((i, k, tuple(ids[k * 16 : k * 16 + 16])) for k in range(len(ids) // 16 + 1))
    assert got == want
    again = shards.write_shards(docs.repartition(7), enc, folder, length=16, per_shard=4, strict=False).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_neighbours_of_outliers_and_few_copies(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 4)), np.tile([500.0, 0, 0, 0], (5, 1)), [[0.0, 900, 0, 0]], [[0.0, 0, -900, 0]]])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    # a list for each far group and one for the rest, as a random start may leave them
    graph = ann.CentroidGraph(np.array([[0.0, 0, 0, 0], x[700], x[705], x[706]]), np.array([[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]), np.array([0]))
    fit, ann.fit = ann.fit, lambda _: graph
    try:
        got = collections.defaultdict(list)
        for r in ann.nearest(v, v.where("vec_id >= 695")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id))
        assert ann.nearest(v.where("vec_id >= 700"), v.where("vec_id = 705")).count() == 6
        assert ann.nearest(v.where("vec_id = 705"), v).count() == 0
    finally:
        ann.fit = fit
    for q in range(695, 707):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[q] == [(n, i) for n, i in enumerate(np.lexsort((np.arange(len(x)), d))[:10].tolist(), 1)]


def test_long_lines_of_two_sites(spark, data):
    long, own = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(i, f"{long}\nx{i}" if i < 8 else f"{own}\nx{i}", "en", "ab"[i % 2] if i < 8 else "a", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: f"x{i}" if 0 < i < 8 else t for i, t, *_ in rows}  # one site only: stays
    assert {r.doc_id: r.text for r in linedup.dedupe_lines(docs).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, data).collect()} == want


def test_readers_keep_to_the_last_whole_run(spark, tmp_path):
    folder, enc = f"file://{tmp_path}/out", shards.RankEncoder(Q.RANK_FILE, bpe.SPLIT, end=50256)
    docs = spark.createDataFrame([(i, "text " * i) for i in range(20)], "doc_id long, text string")
    sizes = {"length": 8, "per_shard": 4}
    n = shards.write_shards(docs, enc, folder, **sizes).count()
    first, digest = np.stack(list(shards.read_slots(folder, 0, n, **sizes))), shards.current(folder)
    shards.write_shards(docs.where("doc_id < 9"), enc, folder, **sizes)  # never evaluated
    assert (np.stack(list(shards.read_slots(folder, 0, n, **sizes))) == first).all()
    out = shards.write_shards(docs.where("doc_id < 15"), enc, folder, **sizes)
    done = out.count()
    name = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("shard-00000001-") and digest not in p.name)
    held = name.read_bytes()
    name.write_bytes(held[:-1])  # as if the job had died midway
    (tmp_path / "out" / ".shard-00000001-x").write_bytes(b"")
    assert shards.publish(folder) == digest and (np.stack(list(shards.read_slots(folder, 0, n, **sizes))) == first).all()
    name.write_bytes(held)
    assert shards.publish(folder, sweep=True) != digest and len(list(shards.read_slots(folder, 0, done, **sizes))) == done
    assert not list((tmp_path / "out").glob(".shard-*"))
