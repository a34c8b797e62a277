"""Training-order materialisation: token sequences in a keyed pseudo-random order, as fixed-stride binary shards.

Documents are encoded and cut into sequences of ``length`` tokens, the last one of each filled up with the end token. The
sequences are numbered from 0 by document id, and by hash and length of the text where ids repeat or are null (counts per range of
these keys, then running sums); equal rows get numbers one after the other. A keyed Feistel network
with cycle-walking permutes the numbers: the result is the sequence's slot in the training order. It needs no table, no sort of
random keys and no global shuffle file, and each slot can be computed alone.

Slots are dealt out by range: a task writes whole shards of ``per_shard`` sequences, each of ``length * width`` bytes, so
sequence s of a shard starts at byte s * length * width and a reader can resume at any slot. A shard is written under a
temporary name and moved into place; a task that runs again, after a lost executor say, writes the same bytes. Shards carry in their name
a digest of all that their bytes depend on (rows and their numbers, encoder, key, lengths). Shards of the same digest that are already there are kept, so a
broken job can be taken up again in the same folder, and shards of other data are never taken for this run's.

Each run leaves a note of its digest and sizes, ``RUN-<time>-<digest>``, before it writes. ``publish`` looks for the newest run of which all shards are there with their
right sizes and names it in the file ``CURRENT``, by a rename; readers do so too if a newer run has left a note. So a run that was never evaluated, or
that died midway, changes nothing for readers.

Texts are encoded twice, first to count sequences and then to cut them: to keep the tokens between the two would be another table of
about 0.8 times the texts, beside the shuffle and the shards. Of each slice of a batch (``SLICE`` bytes of text) every distinct word is encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import xor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPLIT
from .common import materialise, scratch_dir, ship, slices, small

ROUNDS = 6
#: Bytes of text encoded at a time.
SLICE = 4 << 20


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 chosen by ``key``: Feistel rounds on the next even number of bits, walked on while outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


#: White space as Unicode defines it.
WHITE = "\t-\r \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The alternative that looks ahead: of a run of white space before a word, all but the last character.
AHEAD = r"\s+(?!\S)|"
GAP, CUT = f"[{WHITE}][{WHITE}][^{WHITE}]", re.compile(f"(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
#: Patterns by which a new piece begins at every space that no other white space touches.
SPACED = (SPLIT,)
#: A space that touches other white space; what a word holds if its pieces could change between other words.
TOUCH, LOOSE = f" [{WHITE}]|[{WHITE}] ", f"[{WHITE}][{WHITE}]|[{WHITE}]$|^$"


class RankEncoder:
    """Token ids by a rank file (base64 token and rank on each line) and its split pattern; the text has no special tokens.

    Engines run a pattern that doesn't look ahead about twice as fast. So ``AHEAD`` is left out of the pattern, and the few texts in which it
    could matter are cut before the last white space of such runs, which gives the same pieces.

    By the patterns of ``SPACED``, texts are cut before their spaces, and all distinct words of the texts given are encoded once, in one text. First words,
    and texts in which a space touches other white space, are encoded as they are."""

    def __init__(self, path: str, pattern: str, end: int, width: int = 2):
        with open(path, "rb") as f:
            raw = f.read()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.pattern, self.end, self.width, self.digest = pattern, end, width, hashlib.sha256(raw).hexdigest()
        self.spaced = np.zeros(max(self.ranks.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.spaced[[i for t, i in self.ranks.items() if t[:1] == b" "]] = True
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def lists(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        if self._made is None:
            import tiktoken

            self._made = tiktoken.Encoding("ranks", pat_str=self.pattern.replace(AHEAD, ""), mergeable_ranks=self.ranks, special_tokens={})
        one = self._made.encode_ordinary
        gaps = pc.match_substring_regex(pa.array(texts, pa.large_string()), GAP).to_pylist() if AHEAD in self.pattern else [False] * len(texts)
        return [[i for piece in CUT.split(t) for i in one(piece)] if gap else one(t) for t, gap in zip(texts, gaps, strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, f"<u{self.width}") for ids in self.lists(texts)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has; null counts as empty."""
        _, ends, entry, first = self._entries(texts)
        return np.add.reduceat(np.diff(ends)[entry], first, dtype=np.int64)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        ids, ends, entry, first = self._entries(texts)
        found = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids)).take(pa.array(entry)).flatten()
        return found.to_numpy(), np.add.reduceat(np.diff(ends)[entry], first, dtype=np.int64)

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, entry, first): entry e has the ids from ends[e] to ends[e + 1]; text i is made up of the entries entry[first[i]], ... up to the
        next text's. One text at least."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, TOUCH) if self.pattern in SPACED else pa.array([True] * len(texts))
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        heads = self.lists(pc.if_else(whole, texts, pc.list_element(cut, 0)).to_pylist())
        first, later = np.asarray(cut.offsets)[:-1] - cut.offsets[0].as_py(), cut.flatten()
        inner = np.ones(len(later), bool)
        inner[first] = False
        coded = later.filter(pa.array(inner)).dictionary_encode()
        words, loose = coded.dictionary, np.asarray(pc.match_substring_regex(coded.dictionary, LOOSE))
        firm = words.filter(pa.array(~loose)).cast(pa.string())
        # firm words as one text; each begins with its only space
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(firm)], pa.int64()), firm), " ")[0].as_py()
        ids = np.array(self.lists([f" {joined}"])[0] if len(firm) else [], f"<u{self.width}")
        rest = self.lists([f" {w}" for w in words.filter(pa.array(loose)).to_pylist()]) + heads
        sizes = np.concatenate([np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))), np.fromiter(map(len, rest), np.int64, len(rest))])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), ids.dtype)])
        place = np.empty(len(words), np.int64)
        place[np.argsort(loose, kind="stable")] = np.arange(len(words))  # firm words, loose ones, heads
        entry = np.empty(len(later), np.int64)
        entry[inner] = place[np.asarray(coded.indices)]
        entry[first] = len(words) + np.arange(len(texts))
        return ids, np.concatenate([[0], np.cumsum(sizes)]), entry, first


#: Names a distinct row of ``_source``; h and chars are never null.
KEY = ("id", "h", "chars")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("chars"), text.alias("text"))


def _unclear(rows: DataFrame) -> DataFrame:
    """The ids that don't name one row: null, or repeated."""
    return rows.groupBy("id").agg(F.sum("copies").alias("rows")).where("id is null or rows > 1").select("id")


def _sequences(tokens: np.ndarray, length: int) -> np.ndarray:
    return -(-(tokens + 1) // length)


def numbered(docs: DataFrame, encoder: RankEncoder, length: int, id_col: str = "doc_id", text_col: str = "text", strict: bool = False) -> tuple[DataFrame, int, str]:
    """(id, h, chars, copies, n, first) for each distinct row, the number of all sequences, and a digest of the rows and numbers: h and chars
    are hash and length of the text, ``copies`` rows of ``n`` sequences each are numbered from ``first``. Nulls come first. If ``strict``, ids
    that are null or repeated are an error."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(encoder)
    src = _source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                n = _sequences(sent.value.counts(b.column("text")), length)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.array(n, pa.int64())], [*KEY, "n"])

    counts = materialise(src.mapInArrow(run, "id bigint, h bigint, chars int, n bigint"), "sequence-counts")
    rows = counts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(rows.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "ranges")
    if strict and _unclear(ranged).limit(1).count():
        raise ValueError("document ids must be unique and not null")
    every = F.col("copies") * F.col("n")
    mark = F.bit_xor(F.xxhash64("id", "h", "chars", "copies", "n"))  # of distinct rows, in any order
    sums, marks = {}, []
    for r in sorted(ranged.groupBy("part").agg(F.sum(every).alias("n"), mark.alias("mark")).collect(), key=lambda r: r["part"]):  # one row for each range
        sums[r["part"]] = r["n"]
        marks.append(r["mark"])
    start, total = {}, 0
    for p in sorted(sums):
        start[p], total = total, total + sums[p]
    offsets = docs.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "part int, offset bigint")
    before = F.sum(every).over(Window.partitionBy("part").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)) - every
    return ranged.withColumn("before", before).join(F.broadcast(offsets), "part").select(*KEY, "copies", "n", (F.col("offset") + F.col("before")).alias("first")), total, f"{reduce(xor, marks, 0) & (1 << 64) - 1:016x}"


def write_shards(docs: DataFrame, encoder: RankEncoder, folder: str | None = None, length: int = 256, per_shard: int = 8192, key: int = 1, id_col: str = "doc_id", text_col: str = "text", strict: bool = False) -> DataFrame:
    """Writes shards ``shard-<number>-<digest>.bin`` to ``folder`` (a new one in the shared folder if None) when the result is evaluated, and
    returns a row for each sequence: slot, shard, place (in the shard), id, seq_no, n_tokens, without the end token, and sha256
    of the sequence's bytes. The result's attribute ``folder`` names the folder; ``read_slots`` reads it.

    Null texts count as empty: one sequence of end tokens. Every row has slots of its own, also if it is repeated or its id is null or occurs
    twice; equal rows then give rows alike in all but slot, shard and place, and rows that share an id are in the order of hash and
    length of their texts. If ``strict``, such ids raise ValueError instead. Long texts are encoded whole. An empty table writes
    nothing. Extra columns are ignored."""
    spark = docs.sparkSession
    order, total, rows = numbered(docs, encoder, length, id_col, text_col, strict)
    folder = folder or f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    digest = hashlib.sha256(repr((rows, total, encoder.digest, encoder.pattern, encoder.end, encoder.width, length, per_shard, key)).encode()).hexdigest()[:16]
    schema = "slot bigint, shard bigint, place bigint, id bigint, seq_no bigint, n_tokens bigint, sha256 string"
    if not total:
        return _named(spark.createDataFrame([], schema), folder)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    _put(fs, base, f"RUN-{time.time_ns():020d}-{digest}", json.dumps({"digest": digest, "total": total, "per_shard": per_shard, "bytes": length * encoder.width}))
    sent, width = spark.sparkContext.broadcast(encoder), encoder.width
    src, order = _source(docs, id_col, text_col), materialise(order, "order")
    unclear = None if strict else materialise(_unclear(order), "unclear-ids")
    if unclear is None or not unclear.limit(1).count():
        src = src.select("id", "text").join(small(order.select("id", "first")), "id")
    else:
        # an id that names one row is enough to find it; the others are found by the whole key, equal rows once, and repeated from there
        same = F.col("o.id").eqNullSafe(F.col("u.id"))
        alone = order.alias("o").join(small(unclear).alias("u"), same, "left_anti").select("id", "first")
        others = materialise(order.alias("o").join(small(unclear).alias("u"), same, "left_semi"), "unclear-rows").alias("o")
        found = F.col("s.id").eqNullSafe(F.col("o.id")) & (F.col("s.h") == F.col("o.h")) & (F.col("s.chars") == F.col("o.chars"))
        one = src.alias("s").join(small(others), found).select(*(f"s.{c}" for c in (*KEY, "text")), "copies", "n", "first").dropDuplicates(KEY)
        each = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        spread = each.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *KEY, "copy")
        src = src.select("id", "text").join(small(materialise(alone, "alone")), "id").union(spread.select("id", "text", F.col("first") + F.col("copy") * F.col("n")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                tokens, sizes = sent.value.tokens(b.column("text"))
                n = _sequences(sizes, length)
                row, done = np.cumsum(n) - n, np.cumsum(sizes) - sizes  # of each text's start
                full = np.full(int(n.sum()) * length, sent.value.end, tokens.dtype)
                for r, d, k in zip((row * length).tolist(), done.tolist(), sizes.tolist(), strict=True):
                    full[r : r + k] = tokens[d : d + k]
                text = np.repeat(np.arange(len(n)), n)
                seq = np.arange(len(text)) - row[text]
                slot = feistel(np.asarray(b.column("first"))[text] + seq, total, key)
                used = np.clip(sizes[text] - seq * length, 0, length)
                data = pa.Array.from_buffers(pa.large_binary(), len(seq), [None, pa.py_buffer(np.arange(len(seq) + 1) * length * width), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays([pa.array(slot), b.column("id").take(pa.array(text)), pa.array(seq), pa.array(used), data.cast(pa.binary())], ["slot", "id", "seq_no", "n_tokens", "data"])

    cut_up = src.mapInArrow(cut, "slot bigint, id bigint, seq_no bigint, n_tokens bigint, data binary")
    shards = -(-total // per_shard)
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = cut_up.repartitionById(tasks, F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, at, name, own = None, -1, "", uuid.uuid4().hex

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{base}/.{name}.{own}", f"{base}/{name}")

        for b in batches:
            slots, data = b.column("slot").to_pylist(), b.column("data").to_pylist()
            for s, d in zip(slots, data, strict=True):
                if s // per_shard != at:
                    close()
                    at = s // per_shard
                    name = f"shard-{at:08d}-{digest}.bin"
                    want = min(per_shard, total - at * per_shard) * length * width
                    have = fs.get_file_info(f"{base}/{name}")
                    out = None if have.type == pafs.FileType.File and have.size == want else fs.open_output_stream(f"{base}/.{name}.{own}")
                if out is not None:
                    out.write(d)
            cols = [b.column("slot"), pa.array([s // per_shard for s in slots]), pa.array([s % per_shard for s in slots]), *(b.column(c) for c in ("id", "seq_no", "n_tokens"))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())], ["slot", "shard", "place", "id", "seq_no", "n_tokens", "sha256"])
        close()

    return _named(ranged.mapInArrow(write, schema), folder)


def _named(df: DataFrame, folder: str) -> DataFrame:
    df.folder = folder
    return df


def _put(fs: pafs.FileSystem, base: str, name: str, text: str) -> None:
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(text.encode())
    fs.move(own, f"{base}/{name}")


def _get(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_file(path) as f:
        return f.read().decode()


def publish(folder: str, sweep: bool = False) -> str:
    """Names the newest whole run of a folder in ``CURRENT`` and returns its digest; FileNotFoundError if there is none. ``sweep`` also removes the unfinished files of
    failed tasks, which no job may still be writing."""
    fs, base = pafs.FileSystem.from_uri(folder)
    there = {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File}
    if sweep:
        for name in [n for n in there if n.startswith(".shard-")]:
            fs.delete_file(f"{base}/{name}")
    for note in sorted((n for n in there if n.startswith("RUN-")), reverse=True):
        run = json.loads(_get(fs, f"{base}/{note}"))
        sizes = ((s, min(run["per_shard"], run["total"] - s * run["per_shard"]) * run["bytes"]) for s in range(-(-run["total"] // run["per_shard"])))
        if all(there.get(f"shard-{s:08d}-{run['digest']}.bin") == size for s, size in sizes):
            _put(fs, base, "CURRENT", json.dumps({"digest": run["digest"], "note": note}))
            return run["digest"]
    raise FileNotFoundError(f"no whole run in {folder}")


def current(folder: str) -> str:
    """The digest that ``CURRENT`` names, if no newer run has left a note; else ``publish``."""
    fs, base = pafs.FileSystem.from_uri(folder)
    notes = [f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("RUN-")]
    if fs.get_file_info(f"{base}/CURRENT").type == pafs.FileType.File:
        named = json.loads(_get(fs, f"{base}/CURRENT"))
        if named["note"] >= max(notes, default=""):
            return named["digest"]
    return publish(folder)


def read_slots(folder: str, first: int, count: int, length: int = 256, per_shard: int = 8192, width: int = 2) -> Iterator[np.ndarray]:
    """Sequences of the slots first, first + 1, ... in order, read one after the other from the shards of the folder's last whole run."""
    fs, base = pafs.FileSystem.from_uri(folder)
    digest, at = current(folder), first
    while at < first + count:
        shard, place = divmod(at, per_shard)
        take = min(per_shard - place, first + count - at)
        with fs.open_input_file(f"{base}/shard-{shard:08d}-{digest}.bin") as f:
            f.seek(place * length * width)
            yield from np.frombuffer(f.read(take * length * width), f"<u{width}").reshape(take, length)
        at += take
