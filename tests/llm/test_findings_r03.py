"""Work that cost more than it had to, and results that must not change with it."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.llm import bpe
from rasterloom.llm import decontaminate as leak
from rasterloom.llm import queries as Q
from rasterloom.llm import shards

ODD_TEXTS = [None, "", " ", "--", "a", " a", "a ", "A,b;;C", "élan Vital_über 9x", "don't  stop\n\n now", "  x  y", "...A", "z" * 50]


def test_words_are_counted_by_splitting(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    counted = docs.select("doc_id", leak.count_words(F.col("text")).alias("n"))
    assert "regexp_extract_all" not in counted._jdf.queryExecution().optimizedPlan().toString()  # a match object for every word
    want = {i: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for i, t in enumerate(ODD_TEXTS)}
    assert {r.doc_id: r.n for r in counted.collect()} == want


def test_words_that_recur_are_learned_once(monkeypatch):
    enc = bpe.TrieEncoder(bpe.Vocabulary.from_file(Q.TOKENIZER_FILE))
    letters = "abcdefghijkl"
    often = " ".join(f"often{c}" for c in letters)
    texts = [f"{often} " + " ".join(f"rare{a}q{b}" for b in letters) for a in letters]
    want = list(enc.encode_batch(texts))
    enc.known.clear()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 60)
    learned, learn = [], enc.learn
    monkeypatch.setattr(enc, "learn", lambda words: (learned.extend(words), learn(words))[1])
    assert [ids for t in texts for ids in enc.encode_batch([t])] == want
    assert len(enc.known) <= 60 and enc.decode(b"".join(want)) == "".join(texts)
    assert learned.count(" oftenb") == 1 and learned.count(" rarebqb") == 1


def test_endings_are_all_entries_that_end_there(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    rnd = random.Random(4)
    word = lambda n: bytes(rnd.choice(b"abc") for _ in range(n))
    ids = {w: i for i, w in enumerate(sorted({word(rnd.randint(1, 6)) for _ in range(60)}))}
    endings = bpe.Endings(ids)
    for text in (word(200), b"abxcab" + word(50)):
        state = 0
        for e, b in enumerate(text, 1):
            to = endings.edges.get(state << 8 | b)
            state = endings.learn(state, b) if to is None else to
            assert endings.entries[state] == tuple((ids[text[s:e]], e - s) for s in range(max(0, e - 6), e) if text[s:e] in ids)
            assert len(endings.edges) <= endings.own + 3


def test_merging_keeps_to_the_rule():
    enc, rnd = bpe.TrieEncoder(bpe.Vocabulary.from_file(Q.TOKENIZER_FILE)), random.Random(5)

    def rule(word: bytes) -> list[bytes]:
        parts, rank, no = [word[i : i + 1] for i in range(len(word))], enc.v.rank, 1 << 60
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), no))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    for word in [b"", b"a", b"aaaaaaaa", *(bytes(rnd.choice(b" aeinrsth") for _ in range(rnd.randint(2, 14))) for _ in range(400))]:
        assert enc.merge(word) == rule(word)


LETTERS = "a\u00e91 .'s \n\t\x1c\x85\u00a0\u2003\u3000\u200b\u65e5"
SPACES = [None, "", " ", "  ", "a ", " a", "a  ", "a\n", "a b\n", "a b\n\n", "a b\n\nc d", "\na b", "a b ", "a 's b", "don't 's", "z" * 5000, None]


def test_tokens_by_words_equal_those_of_whole_texts():
    import tiktoken

    rng = np.random.default_rng(6)
    draw = lambda letters, most: "".join(rng.choice(list(letters), rng.integers(0, most)))
    texts = SPACES + [draw(LETTERS, 30) for _ in range(3000)] + [draw("ab '\n s.", 12) for _ in range(3000)] + [None]
    for pattern in (bpe.SPLIT, r"\p{L}+| +|[^ \p{L}]+"):  # by the second, spaces stand apart
        enc = shards.RankEncoder(Q.RANK_FILE, pattern, end=50256)
        lib = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=enc.ranks, special_tokens={})
        want = [lib.encode_ordinary(t or "") for t in texts]
        for size in (1, 7, len(texts)):
            for at in range(0, min(len(texts), 900 * size), size):
                for kind in (pa.string(), pa.large_string()):
                    some = pa.array(["x", *texts[at : at + size]], kind).slice(1)
                    ids, n = enc.tokens(some)
                    assert ids.dtype == "<u2" and ids.tolist() == [i for w in want[at : at + size] for i in w]
                    assert n.tolist() == enc.counts(some).tolist() == [len(w) for w in want[at : at + size]]


def test_words_that_recur_are_encoded_once(monkeypatch):
    words = [f"often{c}" for c in "abcdefghijkl"]
    texts = [" ".join(words[i % 5 :] + words) + f" rare{i}q" for i in range(300)]
    enc = shards.RankEncoder(Q.RANK_FILE, bpe.SPLIT, end=50256)
    sent, lists = [], enc.lists
    want = [i for ids in lists(texts) for i in ids]
    monkeypatch.setattr(enc, "lists", lambda some: (sent.extend(some), lists(some))[1])
    ids, n = enc.tokens(pa.array(texts))
    assert ids.tolist() == want and n.sum() == len(want)
    assert sum(map(len, sent)) < sum(map(len, texts)) // 8


def test_shards_of_slices_hold_the_tokens_of_whole_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SLICE", 300)
    rng, enc, folder = np.random.default_rng(7), shards.RankEncoder(Q.RANK_FILE, bpe.SPLIT, end=50256), f"file://{tmp_path}/out"
    rows = [(i, t) for i, t in enumerate([*SPACES, *(" ".join(rng.choice(["the", "theory", "of\n", "9a", ""], k)) for k in rng.integers(0, 200, 100))])]
    out = shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), enc, folder, length=16, per_shard=50).collect()
    back, got = list(shards.read_slots(folder, 0, len(out), length=16, per_shard=50)), {}
    for r in sorted(out, key=lambda r: (r.id, r.seq_no)):
        assert (back[r.slot][r.n_tokens :] == 50256).all() and r.seq_no * 16 == len(got.setdefault(r.id, []))
        got[r.id] += back[r.slot][: r.n_tokens].tolist()
    assert got == {i: enc([t or ""])[0].tolist() for i, t in rows}
