"""Chat formatting with templates that are black boxes: turns are found in the output by rendering successive prefixes of a conversation.

A template is anything that renders a list of (role, text) as one string. The prefixes of 1, 2, ... turns are rendered, and the output of each is compared with that of the
one before: what it adds is the new turn's span. If it doesn't begin with the output before, the template rewrites history; then spans
can't be told from outputs, the conversation counts the turns that did so, and only the whole output stands. Where the text stands within its span is found in the
same way, by rendering the prefix once more with a probe, a character that occurs nowhere else, in place of the last text.

Prefixes grow, so a conversation of n turns costs n renderings of up to n turns. A template may declare its ``reach``: how many turns before it a turn's span depends on.
With a reach of 1 conversations are rendered in segments of bounded size, each turn after the one before it, however long they are;
without one they are rendered whole, in one task each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Fold, fold_groups

PROBE = "\uf8ff"


class MarkedTemplate:
    """``### role: text</turn>`` and a line end for each turn. Backslashes, runs of three or more ``#`` and ``</turn>`` within a text, and a colon within a role,
    get a backslash before them, so that every output can be read back."""

    reach = 1
    _TEXT = re.compile(r"\\|#{3,}|</turn>")
    _ROLE = re.compile(r"\\|:|#{3,}|</turn>")
    _BACK = re.compile(r"\\(\\|:|#{3,}|</turn>)")
    _TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)

    def render(self, turns: Sequence[tuple[str, str]]) -> str:
        return "".join(f"### {self._ROLE.sub(r'\\\g<0>', r)}: {self._TEXT.sub(r'\\\g<0>', t)}</turn>\n" for r, t in turns)

    def unescape(self, text: str) -> str:
        return self._BACK.sub(r"\1", text)

    def read(self, output: str) -> list[tuple[str, str]]:
        """Turns of an output; a ValueError if it isn't one."""
        out, at = [], 0
        while at < len(output):
            m = self._TURN.match(output, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


class Spans:
    """Renders growing prefixes. ``pieces``: of each turn, (what it adds to the output, start and end of its text in that or None)."""

    def __init__(self, template, known: Sequence[tuple[str, str]] = ()):
        self.template, self.turns, self.output = template, list(known), template.render(list(known)) if known else ""
        self.pieces: list[tuple[str, tuple[int, int] | None]] = []
        self.rewritten: list[int] = []

    def add(self, role: str, text: str) -> None:
        before = self.output
        probed = self.template.render([*self.turns, (role, PROBE)])
        self.turns.append((role, text))
        self.output = self.template.render(self.turns)
        if not self.output.startswith(before):
            self.rewritten.append(len(self.turns) - 1)
            self.pieces.append(("", None))
            return
        piece, inner = self.output[len(before) :], None
        if probed.startswith(before) and probed[len(before) :].count(PROBE) == 1:
            head = probed.index(PROBE, len(before)) - len(before)
            tail = len(probed) - len(before) - head - 1
            if len(piece) >= head + tail and piece[:head] == probed[len(before) :][:head] and piece.endswith(probed[len(probed) - tail :] if tail else ""):
                inner = (head, len(piece) - tail)
        self.pieces.append((piece, inner))


class Format(Fold):
    """Rows are (role, text). The state reads turns and the loss mask back from the pieces of the output, one piece after the other."""

    rows, chars = 32, 1 << 20

    def __init__(self, template, loss_role: str = "assistant", outputs: Sequence[str] = ()):
        self.template, self.loss_role, self.outputs = template, loss_role, tuple(outputs)
        kinds = {"formatted": "formatted string", "spans": "spans array<struct<start: bigint, end: bigint, text_start: bigint, text_end: bigint, loss: boolean>>"}
        self.fields = ", ".join(["n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewriting_turns long", *(kinds[o] for o in outputs)])

    def segment(self, rows, before, whole):
        if self.template.reach != 1:
            return rows, [], 0
        spans = Spans(self.template, rows[:1])
        for role, text in rows[1:]:
            spans.add(role, text)
        return rows, spans.pieces, len(spans.rewritten)

    def start(self):
        return {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "rewriting": 0, "last": None, "rows": [], "parts": [], "spans": []}

    def add(self, state, summary):
        rows, pieces, rewriting = summary
        if self.template.reach != 1:
            state["rows"] += rows
            return state
        first = Spans(self.template, [state["last"]] if state["last"] else [])
        first.add(*rows[0])
        state["rewriting"] += len(first.rewritten) + rewriting
        for (piece, at), (role, _) in zip([*first.pieces, *pieces], rows, strict=True):
            self._take(state, piece, at, role)
        state["last"] = rows[-1]
        return state

    def _take(self, state, piece: str, at, role: str) -> None:
        """Turns are read back by the template itself, where it can; else a turn is its role and what stands in its text's span."""
        if hasattr(self.template, "read"):
            turns = self.template.read(piece)
        else:
            turns = [(role, piece[at[0] : at[1]])] if at else []
        for r, t in turns:
            state["turns"].update(f"{r}\n{t}\n".encode())
            state["n"] += 1
        loss = at is not None and role == self.loss_role
        if loss:
            text = getattr(self.template, "unescape", str)(piece[at[0] : at[1]])
            state["loss"].update(text.encode())
            state["loss_chars"] += len(text)
        if "formatted" in self.outputs:
            state["parts"].append(piece)
        if "spans" in self.outputs and at is not None:
            c = state["chars"]
            state["spans"].append({"start": c, "end": c + len(piece), "text_start": c + at[0], "text_end": c + at[1], "loss": loss})
        state["chars"] += len(piece)

    def finish(self, state):
        if self.template.reach != 1 and state["rows"]:
            spans = Spans(self.template)
            for role, text in state["rows"]:
                spans.add(role, text)
            state["rewriting"] = len(spans.rewritten)
            if spans.rewritten:
                self._take(state, spans.output, None, "")
            else:
                for (piece, at), (role, _) in zip(spans.pieces, state["rows"], strict=True):
                    self._take(state, piece, at, role)
        extra = {"formatted": "".join(state["parts"]), "spans": state["spans"]}
        return (state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["rewriting"], *(extra[o] for o in self.outputs))


def format_conversations(turns: DataFrame, template=None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", outputs: Sequence[str] = ()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewriting_turns) of each conversation, read back from its output;
    with ``outputs`` also the output ('formatted') and of each turn its span, that of its text, and whether it bears loss ('spans').

    Turns go by ``turn_col`` (nulls first), then role and text, repeated rows one after the other. Null roles and texts are empty, a null id is a conversation
    like others. A text that holds the probe character is rendered like any other, since the probe stands in for texts. Where ``rewriting_turns``
    isn't 0 the template changed what it had rendered before: of a template of unknown reach the output then stands without spans and loss, of one
    with a reach of 1 those turns are left out of what is read back.
    An empty table gives no rows; other columns are left alone."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    by_turn = F.col("turn").asc_nulls_first()
    dealt = rows.withColumn("head", F.substring("text", 1, 16))
    return fold_groups(dealt, "conv_id", [by_turn, "role", "head"], [by_turn, "role", "text"], Format(template or MarkedTemplate(), loss_role, outputs), ["role", "text"])
