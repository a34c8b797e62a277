"""Byte-level BPE encoding and decoding by depth-first traversal of a trie of distinct words.

Each task takes the words of an Arrow batch that it has not met yet, inserts them in a trie and walks it depth
first. A trie node stands for a word prefix; its state is the *last token* of the encoding of that prefix together with
the node at which this token begins. A child's last token is the longest vocabulary entry that ends there and may follow
the last token of the node where it begins (two tokens may follow one another if BPE leaves their joined bytes as just
these two). The entries that end at a node, longest first, come from an automaton of all entries that goes along with the path, so no
substring is looked up that is none. Prefixes shared by many words are thus encoded once, and a word's ids are read by following the states back.

The vocabulary (a file of fixed size, ``VOCAB_BOUND`` entries at most) is broadcast. A task holds the words of about a megabyte of text (or of one
longer text) at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import columns, fresh, ship, slices

VOCAB_BOUND = 1_000_000
CACHE_WORDS, CACHE_PAIRS = 150_000, 300_000
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split in the faster standard engine, right for texts without the characters of ODD.
PLAIN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
FULL = regex.compile(SPLIT)
#: Characters that the two engines class differently: separators of ASCII, numerals that aren't decimal digits, and all
#: beyond the scripts below, where Unicode versions may differ.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and special strings of a byte-level tokenizer file."""

    def __init__(self, spec: dict):
        stand_in = byte_alphabet()
        raw = lambda s: bytes(stand_in[c] for c in s)
        model = spec["model"]
        self.ids = {raw(k): v for k, v in model["vocab"].items()}
        if len(self.ids) > VOCAB_BOUND:
            raise ValueError("vocabulary too large to broadcast")
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = r
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        if max(self.ids.values()) >= 1 << 20:
            raise ValueError("pairs of ids are packed by 20 bits")

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(json.load(f))


class Endings:
    """The vocabulary entries that end where a text has been read to: Aho-Corasick over the entries' bytes. ``edges`` maps state << 8 | byte to the next
    state and takes in steps by failure links as they are met, at most ``CACHE_PAIRS`` of them; ``entries[state]`` are (id, length), longest first."""

    def __init__(self, ids: dict[bytes, int]):
        self.edges: dict[int, int] = {}
        self.entries: list[tuple] = [()]
        self.back = [0]
        level, deep = {}, {}
        for word, i in ids.items():
            at = 0
            for depth, b in enumerate(word):
                key = at << 8 | b
                if (to := self.edges.get(key)) is None:
                    to = self.edges[key] = len(self.back)
                    self.back.append(0)
                    self.entries.append(())
                    level.setdefault(depth, []).append(key)
                at = to
            deep[at] = (i, len(word))
        self.own = len(self.edges)
        for depth in sorted(level):  # shorter prefixes first: their failure links are known
            for key in level[depth]:
                at = self.edges[key]
                self.back[at] = to = self.step(self.back[key >> 8], key & 255) if depth else 0
                self.entries[at] = (deep[at], *self.entries[to]) if at in deep else self.entries[to]

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte, by the failure links."""
        while (to := self.edges.get(state << 8 | byte)) is None and state:
            state = self.back[state]
        return to or 0

    def learn(self, state: int, byte: int) -> int:
        """``step``, kept among the edges."""
        if len(self.edges) >= self.own + CACHE_PAIRS:
            self.edges = dict(islice(self.edges.items(), self.own))
        to = self.edges[state << 8 | byte] = self.step(state, byte)
        return to


class TrieEncoder:
    """Encodes distinct words by the trie; ``known`` maps a word to its ids as little-endian unsigned 32-bit integers. ``known`` and
    ``follows`` are caches of at most about ``CACHE_WORDS`` and ``CACHE_PAIRS`` entries, some 50 MB together, and have no influence on results; when
``known`` is full, the words that later slices held too stay in it."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()  # known words that a later slice held too
        self.follows: dict[int, bool] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        size = max(vocab.bytes_of) + 1
        self.table = [vocab.bytes_of.get(i, b"") for i in range(size)]
        self.code = [i.to_bytes(4, "little") for i in range(size)]
        self.endings = Endings(vocab.ids)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves the joined bytes of the tokens a and b as these two."""
        if len(self.follows) >= CACHE_PAIRS:
            self.follows.clear()
        x, y = self.table[a], self.table[b]
        known = self.follows[a << 20 | b] = self.merge(x + y) == [x, y]
        return known

    def merge(self, word: bytes) -> list[bytes]:
        """The rule itself on a short string: join the pair of least rank, leftmost first."""
        parts, rank, no = [word[i : i + 1] for i in range(len(word))], self.v.rank.get, 1 << 60
        ranks = [rank(p, no) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < no:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), no)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), no)
        return parts

    def learn(self, words: set[str]) -> None:
        """Insert words in a trie and walk it depth first. Sorted order is that walk: the stack of states holds
        the path of the previous word, cut back to what the next one shares with it."""
        follows, may_follow, table, code, endings, known = self.follows, self.may_follow, self.table, self.code, self.endings, self.known
        entries = endings.entries
        last = [-1]  # last[d]: last token of the encoding of the first d bytes of the path
        states = [0]  # states[d]: state of the automaton after them
        path = b""
        for w in sorted(x.encode("utf-8", "surrogatepass") for x in words):
            n, d = len(w), 0
            top = min(n, len(path))
            while d < top and w[d] == path[d]:
                d += 1
            del last[d + 1 :], states[d + 1 :]
            state, edge = states[d], endings.edges.get
            for e in range(d + 1, n + 1):
                to = edge(state << 8 | w[e - 1])
                if to is None:
                    to = endings.learn(state, w[e - 1])
                    edge = endings.edges.get
                state = to
                for t, size in entries[state]:
                    if size < e:
                        before = last[e - size]
                        fit = follows.get(before << 20 | t)
                        if may_follow(before, t) if fit is None else fit:
                            break
                    elif e < 3 or self.whole(t):
                        break
                else:
                    raise ValueError(f"no encoding of byte {w[e - 1]}")
                last.append(t)
                states.append(state)
            path = w
            out, e = [], n
            while e:
                t = last[e]
                out.append(code[t])
                e -= len(table[t])
            out.reverse()
            known[w.decode("utf-8", "surrogatepass")] = b"".join(out)

    def whole(self, t: int) -> bool:
        """Whether the merges lead to a token from its bytes at all."""
        key = -1 - t
        if (known := self.follows.get(key)) is None:
            known = self.follows[key] = self.merge(self.table[t]) == [self.table[t]]
        return known

    def pieces(self, text: str) -> list[str]:
        return (FULL if ODD.search(text) else PLAIN).findall(text)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        block = [self.parts(t) for t in texts]  # the words of all texts given make one trie
        words = set().union(*(part for doc in block for part in doc if isinstance(part, list)))
        new = words.difference(known)
        self.again |= words - new
        if len(known) + len(new) > CACHE_WORDS:  # what was met only once goes
            kept = {w: known[w] for w in self.again} if len(self.again) + len(words) <= CACHE_WORDS else {}
            known.clear()
            known.update(kept)
            self.again.clear()
            new = words.difference(known)
        self.learn(new)
        for doc in block:
            yield b"".join(b"".join(map(known.__getitem__, p)) if isinstance(p, list) else p for p in doc)

    def parts(self, text: str) -> list:
        """Lists of words, and the ids of special strings between them."""
        if self.special is None or not self.special.search(text):
            return [self.pieces(text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.pieces(text[at : m.start()]), np.array([self.v.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return [*out, self.pieces(text[at:])]

    def decode(self, ids: bytes) -> str:
        """Bytes of the ids, as UTF-8; what is not valid becomes U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Sent:
    """What is broadcast: a vocabulary, and in a worker the encoder that its first task makes for the later ones. Both go when Spark takes the broadcast
    from the worker, before a task of another kind; kept by the module, an encoder and its caches would add to all that the worker does later."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    @cached_property
    def encoder(self) -> TrieEncoder:
        return TrieEncoder(self.vocab)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded")) -> DataFrame:
    """``docs`` with the columns ``keep`` and those of ``outputs``:

    ids (binary, little-endian unsigned 32-bit), n_tokens (long), decoded (string), and their digests
    ids_sha256 and decoded_sha256 (lowercase hex). Null texts count as empty: no ids, decoded is ''. Rows pass through
    one to one, so repeated rows and null ids need no care; other columns are ignored. ``keep`` and ``outputs`` must not
    overlap. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent, own = spark.sparkContext.broadcast(Sent(Vocabulary.from_file(tokenizer_path))), fresh("__text", keep)
    kinds = {"ids": "binary", "n_tokens": "bigint", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    if set(keep) & set(outputs):
        raise ValueError("kept columns and outputs share a name")
    src = docs.select(*columns(keep), *columns([text_col])).toDF(*keep, own)
    schema = T.StructType([*(src.schema[c] for c in keep), *T.StructType.fromDDL(", ".join(f"{c} {kinds[c]}" for c in outputs)).fields])
    arrow = {"ids": pa.binary(), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value.encoder
        for whole in batches:
            for batch in slices(whole, own):
                texts = [t or "" for t in batch.column(own).to_pylist()]
                got: dict[str, list] = {c: [] for c in outputs}
                for ids in enc.encode_batch(texts):
                    text = enc.decode(ids) if "decoded" in got or "decoded_sha256" in got else ""
                    for c, f in (("ids", lambda: ids), ("n_tokens", lambda: len(ids) // 4), ("decoded", lambda: text), ("ids_sha256", lambda: hashlib.sha256(ids).hexdigest()), ("decoded_sha256", lambda: hashlib.sha256(text.encode()).hexdigest())):
                        if c in got:
                            got[c].append(f())
                arrays = [batch.column(c) for c in keep] + [pa.array(got[c], arrow.get(c, pa.string())) for c in outputs]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *outputs])

    return src.mapInArrow(run, schema)
