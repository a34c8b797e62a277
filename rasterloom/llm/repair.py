"""Repair of the structure of conversations: the cheapest edits that make the roles alternate, found by iterative-deepening A*.

A conversation is in order if the first letters of its roles read ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (1), Delete (2;
blank rows and repeats must go), Insert an empty turn (5). A truncated row that is not deleted costs 5 more. The search goes depth first through the edits
in ASCII order of their initials, under a bound on cost that is raised by one until a path is accepted; states (row, automaton state) that failed are kept
with the most that was left to spend there, and not entered again with less. So the first accepted path is the
cheapest one, and among the cheapest the least as text. What is still to pay is bounded from below by the sum over blocks of ``BLOCK`` rows of the
least cost of each block alone.

A conversation of any length is searched in segments: for each state at a segment's start and each at its end the cheapest edits are
found apart, and these are chained in order, with one running hash for each of the four states.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small
from .ordered import Fold, fold_groups

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled turn leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, CUT_SHORT, BLOCK = 2, 5, 1, 5, 4
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 40
_INK = re.compile(r"[^\x20\x09-\x0D]")
#: States that can still be reached from each state.
REACH = (frozenset(range(4)), frozenset((SYSTEM, USER, ASSISTANT)), frozenset((USER, ASSISTANT)), frozenset((USER, ASSISTANT)))


def fault(role: str, text: str, seen: bool) -> int:
    """The first fault of a row: blank, seen before, or truncated."""
    if not _INK.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return FINE if text.rstrip("\t\n\x0b\x0c\r ")[-1] in ".!?" else TRUNCATED


def kept_state(initial: str, state: int) -> int | None:
    """Where a kept row leads, if its role may come next."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def _bounds(rows: list[tuple[str, int]], goals: frozenset) -> list[list[int]]:
    """For each row and state, the least that the rest of the row's block costs from there, plus the blocks after it."""
    n = len(rows)
    alive = [bool(REACH[q] & goals) for q in range(4)]
    table = [[0] * 4 for _ in range(n + 1)]
    ahead = [0 if q in goals else FAR for q in range(4)]
    for _ in range(2):
        ahead = [min(ahead[q], INSERT + ahead[NEXT[q]]) for q in range(4)]
    table[n] = ahead
    for i in range(n - 1, -1, -1):
        after = table[i + 1] if (i + 1) % BLOCK or i + 1 == n else [min(table[i + 1])] * 4
        initial, wrong = rows[i]
        extra = CUT_SHORT if wrong == TRUNCATED else 0
        now = []
        for q in range(4):
            best = DELETE + after[q]
            if wrong not in (BLANK, DUPLICATE):
                best = min(best, REROLE + extra + after[NEXT[q]])
                to = kept_state(initial, q)
                if to is not None:
                    best = min(best, extra + after[to])
            now.append(best)
        for _ in range(2):
            now = [min(now[q], INSERT + now[NEXT[q]]) if alive[q] else FAR for q in range(4)]
        table[i] = now
    return table


def cheapest(rows: list[tuple[str, int]], entry: int = START, goals: frozenset = frozenset((START, ASSISTANT))) -> tuple[int, str] | None:
    """(cost, edits' initials) of the cheapest repair of rows (role initial, fault) from state ``entry`` to one of ``goals``; of the cheapest
    the least in ASCII order. None if there is none (a state after a system turn where no such row is)."""
    n, least = len(rows), _bounds(rows, goals)
    if goals == {SYSTEM} and entry == START and not any(i == "s" and f not in (BLANK, DUPLICATE) for i, f in rows):
        return None
    failed: dict[int, int] = {}  # (row, state) -> the most that could be spent there in vain
    path: list[str] = []

    def walk(i: int, q: int, left: int) -> bool:
        if least[i][q] > left:
            return False
        if i == n and q in goals:
            return True
        at = i * 4 + q
        if failed.get(at, -1) >= left:
            return False
        edits = [("I", i, NEXT[q], INSERT)]
        if i < n:
            initial, wrong = rows[i]
            edits.insert(0, ("D", i + 1, q, DELETE))
            if wrong not in (BLANK, DUPLICATE):
                extra = CUT_SHORT if wrong == TRUNCATED else 0
                to = kept_state(initial, q)
                if to is not None:
                    edits.append(("K", i + 1, to, extra))
                edits.append(("R", i + 1, NEXT[q], REROLE + extra))
        for name, j, to, cost in edits:
            if cost <= left:
                path.append(name)
                if walk(j, to, left - cost):
                    return True
                path.pop()
        failed[at] = left
        return False

    bound, most = least[0][entry], (DELETE + CUT_SHORT) * n + 2 * INSERT
    while bound <= most:
        if walk(0, entry, bound):
            return bound, "".join(path)
        bound += 1
    return None


def repaired(rows: list[tuple[str, str]], edits: str, state: int = START) -> list[tuple[str, str]]:
    """Rows (role, text) after the edits."""
    out, at = [], iter(rows)
    for e in edits:
        role, text = next(at) if e != "I" else ("", "")
        if e == "D":
            continue
        to = kept_state(role[:1], state) if e == "K" else NEXT[state]
        out.append((role if e == "K" else ROLE[to], text))
        state = to
    return out


class Repair(Fold):
    """Rows are (turn, role, text, earlier, gone); rows that are ``gone`` only say that the conversation exists."""

    rows, chars = 32, 1 << 21
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def segment(self, rows, before, whole):
        rows, before, faults = [r for r in rows if not r[3]], before and (before[0], before[1], before[4]), []
        for turn, role, earlier, _, text in rows:
            faults.append(fault(role, text, earlier or before == (turn, role, text)))
            before = (turn, role, text)
        marked = [(r[1][:1], f) for r, f in zip(rows, faults, strict=True)]
        if whole:
            cost, edits = cheapest(marked)
            paths = {(START, -1): (cost, edits)}
        else:
            found = {(q, r): cheapest(marked, q, frozenset((r,))) for q in range(4) for r in range(4)}
            paths = {k: v for k, v in found.items() if v}
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [m[0] for m in marked]
        return {
            "faults": [faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)],
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "ends": (initials[0], initials[-1]) if rows else None,
            "turns": (turns[0], turns[-1], 1 + sum(a != b for a, b in zip(turns, turns[1:], strict=False))) if turns else None,
            "paths": paths,
            "rows": [(r[1], r[4]) for r in rows],
        }

    def start(self):
        return {"faults": [0, 0, 0], "illegal": 0, "last": None, "turns": None, "states": {START: (0, "", hashlib.sha256())}}

    def add(self, state, s):
        state["faults"] = [a + b for a, b in zip(state["faults"], s["faults"], strict=True)]
        state["illegal"] += s["illegal"]
        if s["ends"]:
            if state["last"] is not None:
                state["illegal"] += state["last"] + s["ends"][0] not in LEGAL
            state["last"] = s["ends"][1]
        if s["turns"]:
            first, last, n = s["turns"]
            t = state["turns"]
            state["turns"] = (first, last, n) if t is None else (t[0], last, t[2] + n - (t[1] == first))
        best: dict = {}
        for (q, r), (cost, edits) in s["paths"].items():
            if q in state["states"]:
                c, before, _ = state["states"][q]
                option = (c + cost, before + edits, q, edits)
                if r not in best or option < best[r]:
                    best[r] = option
        after = {}
        for r, (cost, audit, q, edits) in best.items():
            digest, fresh = state["states"][q][2].copy(), not any(e != "D" for e in state["states"][q][1])
            lines = "\n".join(f"{role}:{text}" for role, text in repaired(s["rows"], edits, q))
            if lines:
                digest.update(("" if fresh else "\n").encode() + lines.encode())
            after[r] = (cost, audit, digest)
        state["states"] = after
        return state

    def finish(self, state):
        cost, audit, digest = min((v for q, v in state["states"].items() if q in (-1, START, ASSISTANT)), key=lambda v: v[:2])
        t = state["turns"]
        gaps = min(t[1] - t[0] + 1 - t[2], 2**63 - 1) if t else 0
        return (gaps, *state["faults"], state["illegal"], cost, audit, digest.hexdigest())


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): rows damaged by the checksum of 'conv_id:turn', one kind in twenty each of: gone, text emptied, sentence ends
    removed, repeated, role set to user. Nulls of role, text and in the checksum's key count as one space. Rows that are gone stay, without text, as marks."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(one(id_col), F.lit(":"), one(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("r"), one(text_col).alias("t"), hit.alias("hit"))
    text = F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    role = F.when(F.col("hit") == 0, "").when(F.col("hit") == 4, "user").otherwise(F.col("r"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("hit") == 0).alias("gone"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, gone), which must not be
    null but for conv_id and turn; see ``damaged``.

    Rows are taken by turn (nulls first), then role and text; a null conv_id is a conversation like others. A row repeats another if an earlier one of its
    conversation has its role and text: those of the same turn follow one another, those of other turns are known by an aggregate of 128-bit digests by
    conversation. A role without a letter (empty) is never legal. Conversations without rows have zeros, an empty audit and the hash of an empty text.
    An empty table gives no rows; other columns are left alone."""
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    turns = rows.where("not gone").groupBy("conv_id", key.alias("k")).agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
    again = materialise(turns.where(~F.col("first.turn").eqNullSafe(F.col("last.turn"))).select(F.col("conv_id").alias("c"), F.col("k").alias("dk"), F.col("first.turn").alias("since")), "repeated-turns")
    seen = F.col("dk").isNotNull() & F.col("turn").isNotNull() & (F.col("since").isNull() | (F.col("since") < F.col("turn")))
    marked = rows.withColumn("k", key).join(small(again), F.col("k").eqNullSafe(F.col("dk")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    marked = marked.select("conv_id", "turn", "role", seen.alias("earlier"), "gone", "text", F.substring("text", 1, 16).alias("head"))
    by_turn = F.col("turn").asc_nulls_first()
    return fold_groups(marked, "conv_id", [by_turn, "role", "head"], [by_turn, "role", "text"], Repair(), ["turn", "role", "earlier", "gone", "text"])
