"""Operators against plain versions of their rules, and rows of every odd kind for operators and pipeline stages."""

import collections
import itertools
import re

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import bpe, jaccard, linedup, pii, secrets, shards, toxicity
from rasterloom.llm import queries as Q

from .test_operators import DOCS, brute_pii, docs_of


def texts_of(path):
    return [t for (t,) in duckdb.sql(f"select text from '{path}/documents.parquet' order by doc_id").fetchall()]


# --- toxicity


def test_composition_equals_the_machines_run_apart():
    t = toxicity.Transducer
    machines = [t(0, {(0, "a"): (1, 2.0), (1, "b"): (0, 3.0)}), t(0, {(0, "b"): (2, 0.5), (2, "a"): (1, 0.25), (1, "c"): (0, 1.5)}, {2: 1, 1: 0}), t(1, {(1, "c"): (0, 7.0)}, {0: 1})]
    table = toxicity.compose(machines, "abc")
    for word in itertools.product("abc", repeat=6):
        state, apart = 0, [m.start for m in machines]
        for s in word:
            state, w = table[state, s]
            steps = [m.step(q, s) for m, q in zip(machines, apart, strict=True)]
            apart = [q for q, _ in steps]
            assert w == pytest.approx(np.prod([x for _, x in steps]))


def plain_score(model, text):
    """The grammar's rules without transducers: weights near targets and negations (three words), after reported speech."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        target = negation = 0
        reported = False
        for w in re.findall(r"[^\W\d_]+", clause):
            kind = model.kind.get(w, "o")
            weight = model.weight(w) or (1.0 if kind == "h" else 0.0)
            if kind != "h" and weight:
                kind = "i"
            if kind in "ih":
                arc = 0.4 if kind == "h" else 1.0
                arc *= (2.0 if kind == "h" else 1.5) if target else 1.0
                total += weight * arc * (0.6 if negation else 1.0) * (0.6 if reported else 1.0)
            target, negation = (3 if kind == "t" else max(0, target - 1)), (3 if kind == "n" else max(0, negation - 1))
            reported |= kind == "r"
    return total


def test_toxicity_scores_equal_the_plain_rules(data):
    model = toxicity.Model({"grump": 1.2}, {"idiot": 1.0, "moron": 0.7})
    rng = np.random.default_rng(4)
    words = ["idiot", "grumpy", "moron", "kill", "you", "they", "not", "never", "said", "reported", "house", "tree", ".", "!", "\n"]
    for _ in range(400):
        text = " ".join(rng.choice(words, rng.integers(0, 25)))
        assert model.raw(text) == pytest.approx(plain_score(model, text))
    for text in filter(None, texts_of(data)):
        assert model.raw(text) == pytest.approx(plain_score(model, text))


def test_held_out_labels(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = collections.Counter((r.toxic, r.predicted) for r in Q.op1_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect())
    assert got[1, 1] >= 0.6 * (got[1, 0] + got[1, 1]) and got[0, 1] <= 0.02 * (got[0, 0] + got[0, 1])


def test_lexicon_has_no_limit_and_does_not_depend_on_order(spark):
    rows = [(f"x{i % 40}qu common{i % 7} words{i}", int(i % 2 == 0)) for i in range(2000)]
    one = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    two = toxicity.fit(spark.createDataFrame(rows[::-1], "text string, toxic int").repartition(5))
    assert (one.prefixes, one.words) == (two.prefixes, two.words) and one.slope == pytest.approx(two.slope)
    assert all(one.weight(f"x{i}qu") == one.weight(f"x{i + 2}qu") for i in range(10, 30, 2))


# --- personal data


def brute_extraction(texts, least=0.6, support=3):
    """New spans by document: pattern-instance rounds in plain Python."""
    token = regex.compile(pii.TOKEN)
    base_kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def patterns(v, before, after):
        left = [w for w in regex.split(r"[^\p{L}]+", before.lower()) if w]
        right = [w for w in regex.split(r"[^\p{L}]+", after.lower()) if w]
        shape = regex.sub("[0-9]", "9", regex.sub(r"\p{L}+", "a", v))
        out = [f"ll {left[-2]} {left[-1]}"] if len(left) > 1 else []
        out += [f"rr {right[0]} {right[1]}"] if len(right) > 1 else []
        out += [f"lr {left[-1]} {right[0]}"] if left and right else []
        return out + ([f"ls {left[-1]} {shape}"] if left else []) + ([f"rs {right[0]} {shape}"] if right else [])

    def cut(t, matches):
        ends = [(0, 0), *((m.start(), m.end()) for m in matches), (len(t), len(t))]
        for i, m in enumerate(matches, 1):
            yield m, t[ends[i - 1][1] : m.start()][-80:], t[m.end() : ends[i + 1][0]][:40]

    seeds, kind_of, loose = collections.defaultdict(set), {}, []
    for i, t in enumerate(texts):
        t = t or ""
        valid = {tuple(s.split(":")) for s in filter(None, brute_pii(t).split(","))}
        for k, p in base_kinds.items():
            for m, b, a in cut(t, list(re.finditer(p, t))):
                if (k, str(m.start()), str(m.end())) in valid:
                    kind_of[m.group()] = min(kind_of.get(m.group(), k), k, key=pii.KINDS.index)
                    for x in patterns(m.group(), b, a):
                        seeds[k, m.group()].add(x)
                    seeds[k, m.group()] |= set()
        held = [(int(s), int(e)) for _, s, e in valid]
        for m, b, a in cut(t, list(token.finditer(t))):
            if len(m.group()) >= 4 and not any(s < m.end() and m.start() < e for s, e in held):
                loose.append((i, m.start(), m.end(), m.group(), patterns(m.group(), b, a)))
    edges = {(x[3], p) for x in loose if x[3] not in kind_of for p in x[4]}
    every = edges | {(v, p) for (_, v), ps in seeds.items() for p in ps}
    number = collections.Counter(p for _, p in every)
    found = {}
    while True:
        known = [(k, v, 1.0) for k, v in seeds] + [(k, v, s) for v, (s, k) in found.items()]
        total, count = collections.Counter(), collections.Counter()
        by_value = collections.defaultdict(list)
        for v, p in every:
            by_value[v].append(p)
        for k, v, s in known:
            for p in by_value[v]:
                total[k, p] += s
                count[k, p] += 1
        sure = {(k, p): total[k, p] / (number[p] + pii.PRIOR) for k, p in total if count[k, p] >= support and total[k, p] / (number[p] + pii.PRIOR) >= least}
        more = {}
        for v, p in edges:
            for k in pii.KINDS:
                if (k, p) in sure and v not in found:
                    more[v] = max(more.get(v, (0, "")), (sure[k, p], k), key=lambda x: (x[0], -pii.KINDS.index(x[1]) if x[1] else -9))
        if not more:
            break
        found |= more
    out = collections.defaultdict(set)
    for i, s, e, v, _ in loose:
        k = kind_of.get(v) or found.get(v, (0, None))[1]
        if k:
            out[i].add(f"{k}:{s}:{e}")
    return out


def two_generations():
    first = [f"please write to user{i}@mail.example.com" + (" or call soon" if i % 2 else " at home") for i in range(60)]
    second = [f"please write to nick{i:04} ask bob today" for i in range(12)]  # in a pattern of seeds
    third = [f"they sent n{i:04}q ask bob today" for i in range(2)]  # in a pattern of those
    noise = [f"room {i}00 ask me" for i in range(9)] + ["card 4111111111111111 here", "again 4111111111111111 99 and 12 4111111111111111.", "no 1234567890123456 here"]
    return first + second + third + noise


def test_extraction_equals_brute_force(spark, data):
    for texts in (two_generations(), texts_of(data), texts_of(data.replace("sf0.001", "sf0.01")) + two_generations()):
        want = brute_extraction(texts)
        for r in pii.personal_data(docs_of(spark, texts)).collect():
            assert set(filter(None, r.spans.split(","))) == set(filter(None, r.base_spans.split(","))) | want[r.doc_id], texts[r.doc_id]
    want = brute_extraction(two_generations())
    assert all(want[i] for i in range(60, 74)) and not any(want[i] for i in range(74, 83))


# --- secrets


def brute_links(parts, scope=secrets.SCOPE):
    """Weak parts of (kind, start, end) with complements, by all pairs."""
    role = {"access": "id", "part_id": "id", "assign": "key", "hex": "key", "part_key": "key", "part_endpoint": "endpoint"}
    free = [p for p in parts if not any(secrets.ORDER.index(q[0]) < secrets.ORDER.index(p[0]) and q[1] < p[2] and p[1] < q[2] for q in parts)]
    out = set()
    for p in free:
        others = {role[q[0]] for q in free if role[q[0]] != role[p[0]] and max(q[1] - p[2], p[1] - q[2]) <= scope}
        enough = {"key": bool(others), "id": "key" in others, "endpoint": len(others) == 2}[role[p[0]]]
        if p[0] in secrets.WEAK and enough:
            out.add(p)
    return out


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for d in range(150):
        parts = set()
        for _ in range(int(rng.integers(1, 9))):
            s, k = int(rng.integers(0, 2500)), str(rng.choice(secrets.ORDER))
            parts.add((k, s, s + int(rng.choice([5, 20, 199, 200, 201, 650]))))
        at = int(rng.integers(0, 5)) * 100
        parts |= {("part_id", at, at + 100), ("part_key", at + 300, at + 300 + int(rng.integers(1, 300)))}  # exactly in scope
        rows += [(d, *p) for p in parts]
        want |= {(d, *p) for p in brute_links(parts)}
    spans = spark.createDataFrame(rows, "key int, kind string, start int, end int")
    assert set(map(tuple, secrets.linked(secrets.disjoint(spans)).collect())) == want and want


def test_one_string_does_not_vouch_for_itself(spark):
    key = "Ab1" * 100
    texts = ["see https://www.Example.com/Docs/Page123/HowTo/Install now", f"https://a.example.com/{key} and nothing else", f"client_id={key}", f"{key} client_id=abc", f"client_id=abc {'- ' * 99}{key}", f"client_id=abc {'- ' * 101}{key}"]
    got = {r.doc_id: r.spans for r in secrets.secrets(docs_of(spark, texts)).collect()}
    assert got[0] == got[1] == got[2] == got[5] == ""
    assert got[3] == "part_key:0:300,part_id:301:314" and got[4] == "part_id:0:13,part_key:212:512"


# --- shards and encoders


def test_rank_encoder_equals_its_pattern():
    import tiktoken

    enc = shards.RankEncoder(Q.RANK_FILE, bpe.SPLIT, end=50256)
    lib = tiktoken.Encoding("x", pat_str=bpe.SPLIT, mergeable_ranks=enc.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("a\u00e91 .'s \n\t\x1c\x85\u00a0\u2003\u3000\u200b\u65e5"), rng.integers(0, 30))) for _ in range(4000)]
    assert enc.lists(texts) == [lib.encode_ordinary(t) for t in texts]


def test_shards_of_other_data_are_not_taken_up(spark, tmp_path):
    enc, folder = shards.RankEncoder(Q.RANK_FILE, bpe.SPLIT, end=50256), f"file://{tmp_path}/out"
    for texts in (["one two three", "four"], ["five six seven", "ten"], ["one two three", "four"]):  # all of one size
        out = shards.write_shards(docs_of(spark, texts), enc, folder, length=8, per_shard=2)
        assert out.folder == folder
        rows = out.collect()
        back = list(shards.read_slots(folder, 0, len(rows), length=8, per_shard=2))
        assert {r.id: back[r.slot][: r.n_tokens].tolist() for r in rows} == {i: enc([t])[0].tolist() for i, t in enumerate(texts)}


# --- odd rows


LONG = "word " * 30_000 + "tail " + "x" * 300_000 + " you idiot " + "line\n" * 20_000 + "a@b.example.com token=abcdef123456 " + "y z " * 200_000
CLASHES = "key id score n tokens w pos raw t _k _n_lines _n_removed text_ h c cls place value token kind row d p __text a.b _row".split()


@pytest.fixture(scope="module")
def strange(spark):
    texts = [None, "", " \n ", "one", "a b c d e f", "a b c d e f", LONG, "a b c d e f g\nshared line of some words"]
    rows = [(i if i != 5 else None, t, None if i == 3 else "en", None if i == 4 else f"s{i}", None if i == 2 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[6], (None, None, None, None, None), (None, "", None, None, None), rows[5]]
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit("x").alias(c) for c in CLASHES))
    return df.checkpoint()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, data, strange, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, strange, data)
    rows = out.collect()
    if stage != "bpe":
        assert out.columns == strange.columns and out.dtypes == strange.dtypes
        assert {r.score for r in rows} <= {"x"}
    kept = collections.Counter(r.doc_id for r in rows)
    full = collections.Counter(r.doc_id for r in strange.collect())
    if stage == "near_duplicates":  # one row for an id; rows without an id stay
        assert kept == {None: full[None]} | {i: 1 for i in full if i is not None}
    elif stage == "toxicity":
        assert {i: kept[i] for i in full if i != 6} == {i: n for i, n in full.items() if i != 6}
    else:
        assert kept == full
    none = f(spark, strange.where("false"), data)
    assert none.count() == 0 and none.columns == out.columns


def test_operators_take_odd_rows(spark, tmp_path, strange):
    full = collections.Counter(r.doc_id for r in strange.collect())
    strange.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 1, 1), (6, None, 1), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, query in Q.queries().items():
        if name.split("_")[0] not in ("op7", "op11", "op12", "op13"):  # those that read documents
            got = collections.Counter(r.doc_id for r in query(spark, str(tmp_path)).select("doc_id").collect())
            want = {i: n for i, n in full.items() if i is not None} if name == "op3_jaccard" else full
            assert (set(got) == set(want)) if name == "op6_shards" else (got == want), name
    hit = {r.doc_id: r.n_hit for r in Q.op8_decontamination(spark, str(tmp_path)).collect() if r.doc_id is not None}
    assert hit[4] == 6 and hit[7] == 6 and hit[3] == 0
    pii_row = next(r for r in Q.op9_pii(spark, str(tmp_path)).collect() if r.doc_id == 6)
    assert pii_row.spans == f"email:{LONG.index('a@b')}:{LONG.index(' token=')}"


def test_helper_columns_do_not_overwrite(spark):
    d = docs_of(spark, ["x\ny"]).withColumns({"_k": F.lit(7), "_n_lines": F.lit(8)})
    out = linedup.dedupe_lines(d)
    row = out.first()
    assert row["_k"] == 7 and row["_n_lines"] == 8 and row["__n_lines"] == 2 and out.columns[-1] == "_n_removed"


def test_word_hashes_of_odd_texts():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("aAbB \n\t.\u00e9\x1c\u00df "), rng.integers(0, 40))) for _ in range(800)] + ["", " ", "x" * 10_000, " a", "a ", "A"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    flat, n = jaccard._shingles(*jaccard._words(np.frombuffer(b"".join(raw), np.uint8), ends), 5)
    at, seen = 0, {}
    for t, k in zip(raw, n.tolist(), strict=True):
        w = t.lower().split()
        want = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        assert k == len(want)
        assert seen.setdefault(want, flat[at : at + k].tobytes()) == flat[at : at + k].tobytes()
        at += k
    assert len(set(seen.values())) == len(seen)
