"""What the toxicity stage asks of an executor: a kept text goes to the workers once, and no worker still holds what another operator made."""

import gc

import pyarrow as pa
import pytest

from rasterloom.llm import bpe, toxicity
from rasterloom.llm import queries as Q

TEXTS = [None, "", "you idiot", "a quiet day\nyou said he is an idiot; kill them", "word " * 300_000 + "idiot", "you idiot"]


@pytest.mark.parametrize("text", ["text", "a.text"])
def test_a_kept_text_is_sent_once(spark, text):
    model = toxicity.Model({}, dict.fromkeys(toxicity.INSULTS, 1.0))
    rows = [(i if i < 5 else None, t, "x" * i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, f"id long, `{text}` string, site string").coalesce(1)
    want = sorted(((i, t, x, model.score(t or "")) for i, t, x in rows), key=repr)
    for keep, sent in ((("id", text, "site"), 1), (("id", "site"), 2)):
        scored = toxicity.score(docs, model, text_col=text, keep=keep)
        plan = scored._jdf.queryExecution().analyzed()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().head()
        assert plan.children().head().output().size() == sent
        assert scored.columns == [*keep, "score"]
        assert sorted(map(tuple, scored.collect()), key=repr) == sorted((tuple(v for k, v in zip(("id", text, "site"), r, strict=False) if k in keep) + r[3:] for r in want), key=repr)


def test_encoders_leave_the_workers_with_their_broadcast(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").repartition(4)
    first = [bytes(r.ids) for r in bpe.encode(docs, Q.TOKENIZER_FILE).orderBy("doc_id").collect()]

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "TrieEncoder" for x in gc.get_objects())], pa.int64())], ["n"])

    assert sum(r.n for r in spark.range(0, 80, 1, 8).mapInArrow(held, "n long").collect()) == 0
    assert [bytes(r.ids) for r in bpe.encode(docs, Q.TOKENIZER_FILE).orderBy("doc_id").collect()] == first


def test_slices_are_counted_apart():
    rows = pa.RecordBatch.from_arrays([pa.array(["ab abc " * 100_000, "abcd", "abc"]), pa.array([1, 0, 1], pa.int32())], ["text", "toxic"])
    got: dict = {}
    parts = list(toxicity._counted(iter([rows, rows.slice(1)])))
    for b in parts:
        for f, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[f] = tuple(map(sum, zip(got.get(f, (0, 0)), (t, c), strict=True)))
    assert got == {"": (3, 2), "=ab": (1, 0), "=abc": (3, 0), "abc": (3, 2), "=abcd": (0, 2), "abcd": (0, 2)}
