"""The pipeline's stages on planted documents, and whole runs."""

import collections
import hashlib
import math
import re

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm import toxicity

from .test_edge_cases import plain_score
from .test_operators import brute_components


def test_run(spark, data):
    out = P.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert 0 < out.count() <= docs.count()
    assert out.join(docs, "doc_id", "left_anti").count() == 0


def test_stages_keep_columns_and_catch_planted_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    clean = " ".join(f"plain{i} word{i * 7 % 83}" for i in range(80))
    near = clean.replace("plain40 ", "changed ")
    rows = [(10**7 + k, t, "en", "planted", len(t) if t else None) for k, t in enumerate([clean, clean, near, f"before {item} after", None, "other text " + " ".join(f"q{i}" for i in range(90))])]
    planted = docs.union(spark.createDataFrame(rows, T.StructType(docs.schema.fields)))
    left = P.drop_near_duplicates(spark, planted, data)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.where(f"doc_id >= {10**7}").collect()}
    assert kept == {10**7, 10**7 + 3, 10**7 + 4, 10**7 + 5}
    safe = P.drop_contaminated(spark, planted, data)
    assert safe.columns == docs.columns and safe.where(f"doc_id = {10**7 + 3}").count() == 0
    assert safe.where(f"doc_id in ({10**7}, {10**7 + 4}, {10**7 + 5})").count() == 3
    for stage in (P.drop_toxic, P.drop_boilerplate):
        out = stage(spark, planted, data)
        assert out.columns == docs.columns and out.where(f"doc_id in ({10**7}, {10**7 + 4}, {10**7 + 5})").count() == 3


def test_null_ids(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    for _, stage in P.STAGES[1:4]:
        assert stage(spark, docs, data).count() <= 5


def plain_run(docs, items, model):
    """{doc_id: text} after the four filtering stages. ``docs``: {doc_id: (text, source)}."""
    score = lambda t: 1 / (1 + math.exp(-max(-30, min(30, model.slope * math.log1p(plain_score(model, t or "")) * 2 + model.bias))))
    left = {i: (t, s) for i, (t, s) in docs.items() if score(t) < 0.5}
    sites, keeper = collections.defaultdict(set), {}
    for i, (t, s) in left.items():
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            if s is not None:
                sites[line].add(s)
            keeper[line] = min(i, keeper.get(line, i))
    bad = {x for x, s in sites.items() if len(s) >= (2 if x.count(" ") + 1 >= 50 else 10)}
    cut = {}
    for i, (t, _) in left.items():
        lines = None if t is None else t.split("\n")
        kept = lines and [x for x in lines if x.strip(" ") not in bad or keeper[x.strip(" ")] == i]
        if lines is None or len(kept) == len(lines) or "".join(kept).strip(" "):
            cut[i] = None if t is None else "\n".join(kept)
    groups = brute_components(list(cut.items()))
    alone = {i: t for i, t in cut.items() if groups[i][1] == i}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return {i: t for i, t in alone.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_whole_run_equals_plain_rules(spark, data, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = np.random.default_rng(2)
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    new = lambda n: " ".join(f"{a}{b}" for a, b in zip(rng.choice(["alpha", "beta", "gam"], n), rng.integers(0, 10**6, n), strict=True))
    body, shared = new(90), new(60)
    texts = [body, body, body.replace("alpha", "delta", 2), f"{new(30)} {item} {new(5)}", None, "", *(f"{new(20)}\n{shared}\n{new(9)}" for _ in range(6)), shared, *(f"short shared line\n{new(12)}" for _ in range(12)), *(f"{new(9)}. you idiot, i will kill you. {new(3)}" for _ in range(3))]
    planted = [(10**7 + k, t, "en", f"site{k}", len(t) if t is not None else None) for k, t in enumerate(texts)]
    docs.union(spark.createDataFrame(planted, T.StructType(docs.schema.fields))).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    every = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(every, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    items = [r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    want = plain_run({r.doc_id: (r.text, r.source) for r in every.collect()}, items, model)
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and 10**7 in got and not {10**7 + 1, 10**7 + 2, 10**7 + 3} & set(got)
    library = Tokenizer.from_file(P.TOKENIZER_FILE)
    for i, t in want.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_rows_that_share_an_id_have_one_heir(spark, data):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", f"s{i % 4}", i) for i in range(9)] + [(1, text + " more", "en", "x", 1), (1, None, None, None, None), (2, text, "en", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [[tuple(r) for r in P.drop_near_duplicates(spark, docs.repartition(n, "n_chars"), data).collect()] for n in (1, 3, 7)]
    assert len(runs[0]) == 1 and runs[0] == runs[1] == runs[2]
