"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four small transducers read the symbols of a clause: insults and threats (emit the weight of a lexicon entry), targets
(raise the weight near a person), negation (lowers it for a few words) and reported speech (lowers it for the rest of
the clause). ``compose`` multiplies them into one machine, so a clause is scored in one pass by table look-ups. A
document's score is a logistic of the sum over its clauses.

The lexicon is learned from labelled rows: word beginnings and whole words that mark toxic rows, each with its log likelihood
ratio as weight, over a sample of at most about ``max_rows`` labelled rows (``training_rows``; taken by a hash of the id, and near
copies count once). That sample bounds what the driver and the broadcast hold; all entries that pass the tests enter. Words that no
label shows can be given as seeds; they weigh 1.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, materialise, ship, slices

# Seed words of the grammar.
INSULTS = "idiot moron stupid pathetic worthless scum loser disgusting imbecile dumbass retard bastard imbécile crétin connard salaud dummkopf arschloch vollidiot estúpido idiota imbécil cabrón".split()
THREATS = "kill murder strangle stab hurt destroy tuer töten umbringen matar".split()
TARGETS = "you your yours yourself they them those people he she tu toi vous votre du dich dir ihr sie usted tú ustedes".split()
NEGATIONS = "not never no none neither nor isn aren wasn don doesn didn pas jamais aucun nicht nie kein keine nunca jamás tampoco".split()
REPORTS = "said says say wrote writes claimed quoted quote called according reported dit écrit sagte schrieb dijo escribió".split()

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
MIN_PREFIX, MAX_PREFIX = 3, 8
#: So many nats of evidence weigh as much as a seed word.
UNIT = 5.0
OTHER = "o"


@dataclass(frozen=True)
class Transducer:
    """Weighted transducer over class symbols. arcs: (state, symbol) -> (next state, weight); a missing arc stays in the
    state ``decay`` gives for it (itself by default) with weight 1."""

    start: int
    arcs: dict
    decay: dict = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        return self.arcs.get((state, symbol)) or (self.decay.get(state, state), 1.0)


def compose(machines: list[Transducer], symbols: str) -> dict:
    """The product of transducers that read the same symbols: its reachable arcs, with multiplied weights, as
    (state, symbol) -> (next state, weight), states numbered from 0 (start)."""
    start = tuple(m.start for m in machines)
    number, todo, out = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for s in symbols:
            steps = [m.step(q, s) for m, q in zip(machines, state, strict=True)]
            nxt = tuple(q for q, _ in steps)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            out[number[state], s] = (number[nxt], math.prod(w for _, w in steps))
    return out


def grammar() -> dict:
    """Composition of the transducers. Symbols: i insult, h threat, t target, n negation, r reported speech, o other."""
    window = 3
    near = {q: q - 1 for q in range(1, window + 1)}  # states count down the words since a target or a negation
    lexical = Transducer(0, {(0, "i"): (0, 1.0), (0, "h"): (0, 0.4)})
    target = Transducer(0, {(q, "t"): (window, 1.0) for q in range(window + 1)} | {(q, s): (q - 1, w) for q in near for s, w in (("i", 1.5), ("h", 2.0))}, near)
    negation = Transducer(0, {(q, "n"): (window, 1.0) for q in range(window + 1)} | {(q, s): (q - 1, 0.6) for q in near for s in "ih"}, near)
    reported = Transducer(0, {(0, "r"): (1, 1.0)} | {(1, s): (1, 0.6) for s in "ih"})
    return compose([lexical, target, negation, reported], "ihtnro")


@dataclass
class Model:
    """Lexicon (prefixes and whole words with weights), classes of function words, and the logistic."""

    prefixes: dict
    words: dict
    slope: float = 4.0
    bias: float = -4.0

    def __post_init__(self):
        self.table = grammar()
        self.kind = {w: "t" for w in TARGETS} | {w: "n" for w in NEGATIONS} | {w: "r" for w in REPORTS} | {w: "h" for w in THREATS}
        self.heads = {p[:MIN_PREFIX] for p in self.prefixes} | {w[:MIN_PREFIX] for w in self.words} | {w[:MIN_PREFIX] for w in THREATS}

    def weight(self, w: str) -> float:
        """Lexical weight of a word as an insult; 0 if it is none."""
        best = self.words.get(w, 0.0)
        for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1):
            best = max(best, self.prefixes.get(w[:k], 0.0))
        return best

    def raw(self, text: str) -> float:
        """Sum of the clause scores of the whole text."""
        low = text.lower()
        heads = self.heads
        marked = {w: x for w in set(WORD.findall(low)) if w[:MIN_PREFIX] in heads and (x := self.weight(w) or (1.0 if self.kind.get(w) == "h" else 0.0))}
        if not marked:
            return 0.0
        total = 0.0
        for clause in CLAUSE.split(low):
            tokens = WORD.findall(clause)
            if any(t in marked for t in tokens):
                state = 0
                for t in tokens:
                    k = self.kind.get(t, OTHER)
                    s = k if k == "h" or t not in marked else "i"
                    state, w = self.table[state, s]
                    if s in "ih":
                        total += w * marked.get(t, 0.0)
        return total

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(self.raw(text)) * 2 + self.bias))))


def _features(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        out.add("=" + w)
        out.update(w[:k] for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1))
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash that near copies mostly share: the least checksum of three words in a row."""
    for b in (part for whole in batches for part in slices(whole, "text")):
        sig = []
        for t in b.column("text").to_pylist():
            w = t.split()
            sig.append(min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array(sig, pa.int64())], ["text", "toxic", "sig"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a feature by label, added up over a slice of a batch. The feature '' counts rows."""
    for b in (part for whole in batches for part in slices(whole, "text")):
        yield _tally(b)


def _tally(b: pa.RecordBatch) -> pa.RecordBatch:
    """One slice's counts; a function of its own, so that they are gone before the next slice is counted."""
    c: tuple[Counter, Counter] = (Counter(), Counter())
    for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
        c[y].update(_features(t))
        c[y][""] += 1
    keys = list(c[0].keys() | c[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([c[1][k] for k in keys], pa.int64()), pa.array([c[0][k] for k in keys], pa.int64())], ["f", "t", "c"])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", min_share: float = 0.004, impurity: float = 0.02, evidence: float = 15.0) -> Model:
    """A model from labelled rows (few enough for the driver to hold what they teach; see ``training_rows``). Null texts and labels other
    than 0 and 1 are ignored; with no toxic rows the seeds alone are used. Repeated rows and near copies with one label count once. Order
    and partitioning of the rows have no influence; equally good beginnings go by length, then alphabet. Other columns are ignored.

    A beginning or word enters the lexicon if it marks at least ``min_share`` of the toxic rows (and three), at most ``impurity`` of
    its rows are clean, and its log likelihood ratio against chance is at least ``evidence`` (nats; 15 leaves about one
    chance hit among three million beginnings). Its weight is the log of how much commoner it is in toxic than in clean rows, in ``UNIT``s."""
    ship(labelled.sparkSession)
    rows = labelled.select(labelled[text_col].alias("text"), labelled[label_col].cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    signed = rows.mapInArrow(_signed, "text string, toxic int, sig bigint").groupBy("toxic", "sig").agg(F.min("text").alias("text")).select("text", "toxic")
    counts = materialise(signed.mapInArrow(_counted, "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "features")
    head = counts.where("f = ''").first()
    total = (head["t"], head["c"]) if head else (0, 0)
    base, n = total[0] / max(1, sum(total)), F.col("t") + F.col("c")
    good = []
    if total[0]:
        gain = F.col("t") * F.log(F.col("t") / n / base) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / max(1 - base, 1e-9))).otherwise(0.0)
        good = counts.where((F.col("f") != "") & (F.col("t") >= max(3, min_share * total[0])) & (F.col("c") <= impurity * n)).where(gain >= evidence).collect()
    prefixes: dict[str, float] = {}
    words = dict.fromkeys(INSULTS, 1.0)
    for r in sorted(good, key=lambda r: (len(r["f"].lstrip("=")), r["f"])):
        f, weight = r["f"], math.log((r["t"] + 0.5) * (total[1] + 1) / ((r["c"] + 0.5) * (total[0] + 1))) / UNIT
        if f[0] == "=":
            words[f[1:]] = weight
        elif not any(f[:k] in prefixes for k in range(MIN_PREFIX, len(f))):
            prefixes[f] = weight
    model = Model(prefixes, words)
    # the logistic: over the few distinct sums of clause scores in the sample
    bins = score(signed.select("text", "toxic"), model, keep=("toxic",), raw=True).groupBy("toxic", F.round("raw", 1).alias("raw")).count().collect()
    if total[0] and total[1]:
        w = [0.0, 0.0]
        data = [(2 * math.log1p(r["raw"]), r["toxic"], r["count"] * (0.5 / total[0] if r["toxic"] else 0.5 / total[1])) for r in bins]
        for _ in range(60):  # Newton steps with a small ridge
            g0 = g1 = h00 = h01 = h11 = 0.0
            for x, y, n in data:
                p = 1 / (1 + math.exp(-max(-30, min(30, w[0] * x + w[1]))))
                g0, g1 = g0 + n * (p - y) * x, g1 + n * (p - y)
                v = n * max(p * (1 - p), 1e-6)
                h00, h01, h11 = h00 + v * x * x, h01 + v * x, h11 + v
            g0, h00, h11 = g0 + 1e-3 * w[0], h00 + 1e-3, h11 + 1e-6
            det = h00 * h11 - h01 * h01
            step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
            w = [w[0] - max(-1, min(1, step[0])), w[1] - max(-1, min(1, step[1]))]
        slope, bias = w
        if slope > 0:
            model.slope, model.bias = slope, bias
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), raw: bool = False, name: str | None = None) -> DataFrame:
    """``keep`` and the score (0 to 1) of each whole text, however long, as ``name`` (default: score); ``raw=True`` gives the sum of
    clause scores instead (default name: raw). ``keep`` must not hold ``name``; other columns are ignored.

    Null texts count as empty and score like a text without any word of the lexicon. Row by row, without a shuffle: repeated rows and null
    ids pass through, an empty table gives no rows. The model is bounded by ``fit``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = name or ("raw" if raw else "score")
    if name in keep:
        raise ValueError(f"a column {name} is kept already")
    kept = F.struct(*columns(keep)).alias("kept")  # a struct: names may hold dots
    at = keep.index(text_col) if text_col in keep else None  # a text that is kept anyway is sent once
    src = docs.select(kept) if at is not None else docs.select(kept, *(c.alias("text") for c in columns([text_col])))
    schema = T.StructType([src.schema["kept"], T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value.raw if raw else sent.value.score
        for whole in batches:
            text = whole.column("text") if at is None else whole.column("kept").field(at)
            for b in slices(pa.RecordBatch.from_arrays([whole.column("kept"), text], ["kept", "text"]), "text"):
                values = [f(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(values, pa.float64())], ["kept", "value"])

    return src.mapInArrow(run, schema).select("kept.*", F.col("value").alias(name))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Texts and labels to fit on: of the ids whose checksum modulo 5 isn't 0, about ``max_rows`` at most, taken by a hash of
    the id; an id with several labels has the greatest. The sampled labels are bounded by ``max_rows``, so they are broadcast and the texts
    are not shuffled."""
    own = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n = own.count()
    sample = own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(min(1.0, max_rows / max(n, 1)) * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
