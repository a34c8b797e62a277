"""Formatting and repair of conversations against plain rules, with templates and rows of every odd kind."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import chat, repair
from rasterloom.llm import queries as Q
from rasterloom.llm.ordered import HELD

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    rows = df.collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append(r)
    return out


TRICKY = ["", " ", "\\", "\\\\### x", "####</turn>\n### user: y", "</turn></turn>", chat.PROBE, "a" * 50_000 + "</turn>", "é🎉\x00\n", "\\</turn>", ": \\: ###", "<", "</turn"]


# --- formatting


@pytest.mark.parametrize("text", TRICKY)
def test_template_reads_back(text):
    t = chat.MarkedTemplate()
    turns = [(text, text), ("user", text), (text, "x")]
    assert t.read(t.render(turns)) == turns
    body = t.render([("user", text)])[len("### user: ") : -len("</turn>\n")]
    assert not re.search(r"(?<!\\)(?:\\\\)*</turn>", body) and t.unescape(body) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("\\#</turn>: \na"), st.text("\\#</turn>: \na")), max_size=5))
def test_template_reads_back_any_turns(turns):
    t = chat.MarkedTemplate()
    assert t.read(t.render(turns)) == turns


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, 5, None, "x"), (2, None, "user", None), (2, 1, "assistant", None), (None, 0, "assistant", "q"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i} \\### </turn>.") for i in range(5000)]  # one that goes through many segments and tasks
    rows += [(100 + i % 40, i // 40, ("user", "assistant")[i // 40 % 2], f"t{i}.") for i in range(400)]
    return rows, spark.createDataFrame(rows, TURNS).repartition(7).withColumns({c: F.lit("z") for c in ("group", "_part", "_no", "_summary", "head", "k", "copy", "gone")})


def test_formatting_equals_plain_rules(spark, odd_turns):
    rows, df = odd_turns
    got = by_id(chat.format_conversations(df, outputs=("formatted", "spans")))
    template = chat.MarkedTemplate()
    want = grouped(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r or "", t or "") for _, _, r, t in turns]
        g, output = got[c], template.render(turns)
        assert g.formatted == output and g.formatted_chars == len(output) and g.n_turns == len(turns) and g.rewriting_turns == 0
        assert g.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        loss = "".join(t for r, t in turns if r == "assistant")
        assert g.loss_sha256 == sha(loss) and g.loss_chars == len(loss)
        assert g.spans[0].start == 0 and all(a.end == b.start for a, b in zip(g.spans, g.spans[1:], strict=False)) and g.spans[-1].end == len(output)
        assert [template.unescape(output[s.text_start : s.text_end]) for s in g.spans] == [t for _, t in turns]
        assert [s.loss for s in g.spans] == [r == "assistant" for r, _ in turns]
    assert chat.format_conversations(df.where("false")).count() == 0


class Forgetful:
    """Keeps the reasoning of the last turn only."""

    reach = None

    def render(self, turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else re.sub('<think>.*?</think>', '', t)}\n" for i, (r, t) in enumerate(turns))


class Plain:
    reach = None

    def render(self, turns):
        return "".join(f"<{r}|{t.strip()}>" for r, t in turns)


def test_templates_that_rewrite_history_are_found(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<think>a</think>yes"), (1, 2, "user", "more"), (1, 3, "assistant", "ok"), (2, 0, "user", "a"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, TURNS)
    got = by_id(chat.format_conversations(df, Forgetful(), outputs=("formatted", "spans")))
    assert got[1].rewriting_turns == 1 and got[1].spans == [] and got[1].loss_chars == 0 and got[1].formatted == "[user]hi\n[assistant]yes\n[user]more\n[assistant]ok\n"
    assert got[2].rewriting_turns == 0 and [(s.text_start, s.text_end, s.loss) for s in got[2].spans] == [(6, 7, False), (19, 20, True)]
    plain = by_id(chat.format_conversations(df, Plain(), outputs=("spans",)))
    assert plain[1].rewriting_turns == 0 and plain[1].n_turns == 4 and plain[1].loss_sha256 == sha("<think>a</think>yesok")


def test_the_query_holds_its_own_conversation(spark, data):
    r = by_id(Q.op11_chat(spark, data))[Q.TRICKY_ID]
    assert r.n_turns == 2 and r.loss_sha256 == sha(Q.TRICKY_TEXT) and r.loss_chars == len(Q.TRICKY_TEXT)
    assert r.turns_sha256 == sha(f"user\n{Q.TRICKY_TEXT}\nassistant\n{Q.TRICKY_TEXT}\n")


# --- repair


def dijkstra(rows):
    """Cheapest edits by (cost, edits): a plain search of the whole graph."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, edits
        if (i, q) in done:
            continue
        done.add((i, q))
        step = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        heapq.heappush(heap, (cost + 5, edits + "I", i, step))
        if i < len(rows):
            z, f = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, q))
            if f not in (1, 2):
                extra = 5 * (f == 3)
                heapq.heappush(heap, (cost + 1 + extra, edits + "R", i + 1, step))
                to = {"s": 1 if q == 0 else None, "u": None if q == 2 else 2, "a": 3 if q == 2 else None}.get(z)
                if to is not None:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, to))
    return None


MARKED = st.lists(st.tuples(st.sampled_from("suax") | st.just(""), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


@settings(max_examples=400, deadline=None)
@given(MARKED)
def test_search_finds_the_least_cheapest_edits(rows):
    assert repair.cheapest(rows) == dijkstra(rows)


@settings(max_examples=100, deadline=None)
@given(MARKED, st.integers(1, 4))
def test_segments_chain_to_the_whole(rows, size):
    best = {repair.START: (0, "")}
    for i in range(0, len(rows), size):
        after = {}
        for q, (cost, edits) in best.items():
            for r in range(4):
                found = repair.cheapest(rows[i : i + size], q, frozenset((r,)))
                if found:
                    after[r] = min(after.get(r, (10**9, "")), (cost + found[0], edits + found[1]))
        best = after
    assert min(v for q, v in best.items() if q in (0, 3)) == dijkstra(rows)


def plain_repair(rows):
    """Rows (turn, role, text) of one conversation, in order, without nulls but in turn."""
    faults, seen = [], set()
    for _, r, t in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", t)
        faults.append(1 if not ink else 2 if (r, t) in seen else 0 if ink[-1] in ".!?" else 3)
        seen.add((r, t))
    cost, audit = dijkstra([(r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True)])
    out, at, q = [], iter(rows), 0
    for e in audit:
        _, r, t = next(at) if e != "I" else (0, "", "")
        if e != "D":
            q = {"s": 1, "u": 2, "a": 3}[r[0]] if e == "K" else {0: 2, 1: 2, 2: 3, 3: 2}[q]
            out.append(f"{r if e == 'K' else {2: 'user', 3: 'assistant'}[q]}:{t}")
    turns = [t for t, _, _ in rows if t is not None]
    z = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), sum(a + b not in ("su", "ua", "au") for a, b in zip(z, z[1:], strict=False)), cost, audit, sha("\n".join(out)))


def plain_damage(rows):
    out = {}
    for c, turn, r, t in rows:
        r, t = " " if r is None else r, " " if t is None else t
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        t = "" if hit == 1 else re.sub("[.!?]", "", t) if hit == 2 else t
        mine = out.setdefault(c, [])
        mine += [(turn, "user" if hit == 4 else r, t)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def test_repair_equals_plain_rules(spark, odd_turns):
    rng = np.random.default_rng(3)
    rows, _ = odd_turns
    rows = [*rows, (4, None, "user", None), (4, None, "user", None), (5, 7, None, None), (6, 0, "", "x."), (6, 1, "user", "x."), (6, 2, "assistant", "y?")]
    words = ["", " ", "a.", "b", "c!", "same text."]
    rows += [(1000 + int(c), int(t), str(r), str(w)) for c, t, r, w in zip(rng.integers(0, 300, 2500), rng.integers(0, 12, 2500), rng.choice(["user", "assistant", "system", "tool"], 2500, p=[0.4, 0.4, 0.1, 0.1]), rng.choice(words, 2500), strict=True)]
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({c: F.lit("z") for c in ("group", "_part", "_no", "_summary", "head", "k", "c", "dk", "since")})
    got = by_id(repair.repair(repair.damaged(df)))
    want = plain_damage(rows)
    assert set(got) == set(want)
    for c, mine in want.items():
        assert tuple(got[c])[1:] == plain_repair(mine), c
    assert repair.repair(repair.damaged(df.where("false"))).count() == 0


def test_a_conversation_of_many_segments_is_spread(spark):
    n = 32 * (HELD + 5)
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(n)]
    got = repair.repair(spark.createDataFrame(rows, TURNS).withColumn("gone", F.lit(False))).collect()
    assert [(r.cost, r.audit, r.gaps) for r in got] == [(0, "K" * n, 0)]
