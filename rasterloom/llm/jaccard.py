"""Exact similarity join of word-shingle sets, by a token-group matrix.

Tokens are hashes of the distinct five-word shingles of a document. The steps:

1. Documents with equal sets form a class, named by 63 bits of a digest of the set; one class stands for all its copies. Among
   ten billion different sets about five pairs would share a name by chance. Sets are made again from the texts where
   they are needed, which costs less than to store and shuffle them.
2. A total order of tokens, rarest first: tokens met often within a batch of texts come last (the ``HEAVY`` commonest of
   them are told apart by their counts). Only speed depends on how well this follows true frequency.
3. Prefixes: if two sets are similar, the first n - ceil(t*n) + s tokens of each in that order share s tokens at least (s is a
   tenth of n; of two sets, the smaller s counts). Tokens that stand in
   the prefixes of one class only are dropped, which leaves a small share of all tokens.
   Classes that share too few tokens with others go, and of the rest only as many rows are kept as are needed to meet.
4. Stars: the classes of each token against a few hubs, checked exactly. The components of the links found make the groups, so copies of
   one text never meet one another in pairs.
5. Token-group matrix: components, and classes without links that share their commonest token, are groups, in blocks of about
   ``BLOCK`` classes, with the union of their members' tokens. A class meets groups of *other* components only. The overlap of its whole set with the group's union bounds its overlap
   with any member; only groups that pass are opened, and members compared exactly.
6. Components of all links.

No step holds a group of unbounded size in one task: stars are joins, blocks are bounded, hot tokens are split by Spark's
skew join. Pairs that are already known to be connected are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, small

HEAVY = 500_000
CHUNK, SLICE = 1_000_000, 1 << 18
BLOCK, HUBS = 32, 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: White space of the word rule, and a random number for each byte: none for white space, and that of a-z for A-Z.
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.where(_SPACE, np.uint64(0), np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64))
_BYTE[65:91] = _BYTE[97:123]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, one after the other, and the number of words of each. ``data``: their UTF-8 bytes; text i has
    those from offsets[i] to offsets[i + 1]. A word's hash is a polynomial in its bytes' numbers, mixed."""
    m = len(offsets) - 1
    space = _SPACE[data]
    begins = ~space
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    keep = begins[edge]
    begins[1:] &= space[:-1]
    begins[edge] = keep  # a text's first byte begins a word whatever stands before it
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(m, np.int64)
    data = data[first[0] :]
    start = first - first[0]
    size = np.diff(start, append=len(data))  # with the white space that follows, which adds nothing
    place = np.arange(len(data)) - np.repeat(start, size)
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return _mix(np.add.reduceat(_BYTE[data] * power[place], start)), np.bincount(np.searchsorted(offsets, first, "right") - 1, minlength=m)


def _shingles(h: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their numbers. ``h``, ``n``: what ``_words`` gives. A text of
    fewer than ``size`` words has one shingle, all of them."""
    first = np.cumsum(n) - n
    made = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = np.cumsum(made) - made
    out = np.empty(int(made.sum()), np.uint64)
    owner = np.repeat(np.arange(len(n)), made)
    begin = first[owner] + np.arange(len(out)) - at[owner]
    for k in {size, *n[(n > 0) & (n < size)].tolist()}:
        rows = np.flatnonzero((n == k if k < size else n >= k)[owner])
        s = np.full(len(rows), k, np.uint64)
        for i in range(k):
            s = _mix(s) + h[begin[rows] + i]
        out[rows] = _mix(s)
    for i in np.flatnonzero(made > 1):
        out[at[i] : at[i] + made[i]].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.bincount(owner[fresh], minlength=len(n))


def _tokens(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; A-Z lower-cased, words split at ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    return _shingles(*_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), size)[0]


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``SLICE`` bytes of text (one text at least), the token sets of their rows one after the other, the sets'
    sizes, and 63 bits of a digest of each set: its class."""
    for whole in batches:
        column = whole.column("text").cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            flat, n = _shingles(*_words(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]), size)
            stop = np.cumsum(n)
            cls = np.array([xxhash.xxh3_64_intdigest(flat[e - k : e]) >> 1 for e, k in zip(stop.tolist(), n.tolist(), strict=True)], np.int64)
            yield whole.slice(at, to - at), flat, n, cls
            at = to


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))


def scan(src: DataFrame, size: int) -> DataFrame:
    """A row (id, n, cls) for each document, and rows (token, c) for tokens that documents of a chunk share: three of them in a
    chunk of about ``CHUNK`` tokens, two in a much smaller one."""

    names, none = ["id", "n", "cls", "token", "c"], lambda k: pa.nulls(k, pa.int64())

    def often(chunk: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(chunk)
        flat.sort()
        least = 3 if len(flat) > CHUNK // 8 else 2
        at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        c = np.diff(np.append(at, len(flat)))
        tok, c = flat[at[c >= least]], c[c >= least]
        return pa.RecordBatch.from_arrays([none(len(c)), none(len(c)), none(len(c)), pa.array(tok.view(np.int64)), pa.array(c.astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for b, flat, n, cls in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(cls), none(len(n)), none(len(n))], names)
            for i in range(0, len(flat), CHUNK):  # a long text is more than one chunk
                chunk.append(flat[i : i + CHUNK])
                held += len(chunk[-1])
                if held >= CHUNK:
                    yield often(chunk)
                    chunk, held = [], 0
        if held:
            yield often(chunk)

    return src.mapInArrow(run, "id bigint, n bigint, cls bigint, token bigint, c bigint")


def heavy_tokens(scanned: DataFrame, top: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens, ascending, and their counts. Bounded by ``top`` (16 bytes each); it only orders tokens."""
    counted = scanned.where("token is not null").groupBy("token").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.desc("c"), "token").limit(top).orderBy("token").toArrow()
    return np.asarray(rows.column("token")), np.asarray(rows.column("c"))


def slack(n):
    """How many tokens the prefixes of two similar sets share at least: the smaller set's count, as prefixes are longer by it."""
    return n // 10 + 1


def prefixes(src: DataFrame, size: int, heavy: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(token, cls, n) of the prefix of each set: its first n - ceil(percent*n/100) + slack(n) tokens, rarest first. Copies
    within a slice count once."""
    sent = src.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = sent.value
        # which stretches of the hash range hold a common token: most tokens are told from those without a search
        stretch = np.zeros(1 << 22, bool)
        stretch[common.view(np.uint64) >> np.uint64(42)] = True
        for _, flat, n, cls in _sets(batches, size):
            end = np.cumsum(n)
            one = np.zeros(len(n), bool)  # the first row of each class that isn't empty
            one[np.unique(cls, return_index=True)[1]] = True
            one &= n > 0
            flat, n, cls = flat[np.repeat(one, n)], n[one], cls[one]
            if not len(n):
                continue
            end = np.cumsum(n)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            limit = n - (percent * n + 99) // 100 + slack(n)
            weight = np.zeros(len(flat), np.int64)
            some = np.flatnonzero(stretch[flat >> np.uint64(42)])
            if len(some):
                tok = flat[some].view(np.int64)
                at = np.minimum(np.searchsorted(common, tok), len(common) - 1)
                weight[some] = np.where(common[at] == tok, count[at], 0)
            # by weight, then hash: those without weight first, as they stand; the others sorted where there is room for them
            light = weight == 0
            run_of = np.cumsum(light)
            before = np.where(end > n, run_of[end - n - 1], 0)
            take = light & (run_of - np.repeat(before, n) <= np.repeat(limit, n))
            room = limit - (run_of[end - 1] - before)
            rest = np.flatnonzero(~light & np.repeat(room > 0, n))
            rest = rest[np.lexsort((weight[rest], doc[rest]))]
            each = np.bincount(doc[rest], minlength=len(n))
            place = np.arange(len(rest)) - np.repeat(np.cumsum(each) - each, each)
            take[rest[place < room[doc[rest]]]] = True
            owner = doc[take]
            yield pa.RecordBatch.from_arrays([pa.array(flat[take].view(np.int64)), pa.array(cls[owner]), pa.array(n[owner].astype(np.int32))], ["token", "cls", "n"])

    return src.mapInArrow(run, "token bigint, cls bigint, n int")


def token_sets(src: DataFrame, size: int) -> DataFrame:
    """(cls, n, tokens as longs) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, n, cls in _sets(batches, size):
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n, pa.int64()), lists], ["cls", "n", "tokens"])

    return src.mapInArrow(run, "cls bigint, n bigint, tokens array<bigint>")


def _similar(n1: Column, n2: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (n1 + n2 - both)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable by (a, b) edges, for the nodes that have edges.

    Rounds of joining each node to the least label around it and then to that label's own label; each round is written to
    the shared folder, so lineage stays short. The number of rounds grows with the logarithm of the longest path, mostly."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        far = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = label.join(far, label["node"] == far["a"]).select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # the old root learns of the better label too (hooking), then everyone jumps
        hook = step.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("h"))
        nxt = step.join(up, "root", "left").join(hook, "node", "left").select("node", "old", F.least("root", F.coalesce("top", "root"), F.coalesce("h", "root")).alias("root"))
        nxt = materialise(nxt, "labels")
        if nxt.where("root <> old").limit(1).count() == 0:
            return nxt.select("node", "root")
        label = nxt.select("node", "root")


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(_similar(F.col("na"), F.col("nb"), both, percent)).select("a", "b")


def _size_bound(small_n, large_n, percent: int) -> Column:
    """Sets can be similar only if the smaller has at least this share of the larger."""
    return 100 * F.least(small_n, large_n) >= percent * F.greatest(small_n, large_n)


def between(member: DataFrame) -> DataFrame:
    """The rows of (token, cls, n, comp) whose token stands in more than one component."""
    apart = member.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return member.join(small(materialise(apart, "apart")), "token")


def thinned(near: DataFrame, percent: int, cut: bool = True) -> DataFrame:
    """The rows of (token, cls, n) that can still lead to a similar pair.

    Similar sets share s tokens of their prefixes at least, s being slack() of the smallest size that fits. So a class with fewer rows than s
    goes. With ``cut``, of m rows only the m - s + 1 whose tokens are rarest (now counted exactly, in prefixes) stay: enough to meet
    in one token, so this can be done once only."""
    least = F.floor(F.ceil(F.col("n") * percent / 100) / 10) + 1
    freq = near.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = near.join(freq, "token")
    order = Window.partitionBy("cls").orderBy("f", "token")
    ranked = held.withColumns({"k": F.row_number().over(order), "m": F.count(F.lit(1)).over(Window.partitionBy("cls"))})
    rest = ranked.where((F.col("m") >= least) & (F.col("k") <= F.col("m") - least + 1)) if cut else ranked.where(F.col("m") >= least)
    return rest.select("token", "cls", "n")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs`` whose id isn't null.

    Two rows link if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest id
    reachable by links, itself included. Rows with an empty set link with nothing. Rows that share an id are linked by it: they are
    one document. Ids are integers. An empty table gives no rows. Extra columns are ignored."""
    src = _source(docs, id_col, text_col)
    scanned = materialise(scan(src, size), "scan")
    keys = scanned.where("id is not null").select("id", "n", "cls")
    full = keys.where("n > 0")
    prefix = materialise(prefixes(src, size, heavy_tokens(scanned), percent), "prefix")
    shared = prefix.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token")
    near = materialise(prefix.join(materialise(shared, "shared"), "token").distinct(), "near")
    near = materialise(thinned(materialise(thinned(near, percent, cut=False), "viable"), percent), "thinned")

    def sets_of(classes: DataFrame) -> DataFrame:
        """(cls, n, tokens) of the classes named, made from one text each."""
        one = full.join(small(materialise(classes.distinct(), "asked")), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
        ids = materialise(one.select("id").distinct(), "ids")
        return materialise(token_sets(src.join(small(ids), "id", "left_semi"), size).join(small(one), "cls", "left_semi").dropDuplicates(["cls"]), "wanted")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        pairs = materialise(pairs.distinct(), label)
        return materialise(verified(pairs, sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))), percent), f"{label}-linked")

    # stars: the classes of a token against its hubs, the first ones in a few random orders; of these, each class tries the one that it
    # shares most tokens with, order by order. A first guess at groups: pairs that share few tokens are left to the last step.
    hubs = near.groupBy("token").agg(*(F.min(F.struct(F.xxhash64("cls", F.lit(j)).alias("o"), F.col("cls").alias("hub"), F.col("n").alias("hub_n"))).alias(f"h{j}") for j in range(HUBS)))
    hubs = hubs.select("token", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), f"h{j}.hub", f"h{j}.hub_n") for j in range(HUBS)))).alias("h")).select("token", "h.*")
    star = near.join(hubs, "token").where((F.col("cls") != F.col("hub")) & _size_bound("n", "hub_n", percent)).groupBy("cls", "j", "hub", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.col("n") / 15)
    links = linked(star.groupBy("cls", "j").agg(F.max_by("hub", F.struct("c", "hub")).alias("b")).select(F.col("cls").alias("a"), "b"), "guesses")
    first = components(links)

    # token-group matrix: classes against the groups of other components
    member = near.join(small(first.withColumnRenamed("node", "cls")), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    sizes = materialise(first.groupBy(F.col("root").alias("comp")).agg(F.count(F.lit(1)).alias("members")), "sizes")
    placed = materialise(between(member).join(small(sizes), "comp", "left").withColumn("members", F.coalesce("members", F.lit(1))), "placed")
    # every class has one group: a block of its component or, without links yet, of the classes with the same commonest token
    freq = placed.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    lead = placed.where("members = 1").join(freq, "token").groupBy("cls").agg(F.max(F.struct("f", "token")).alias("m")).select("cls", F.col("m.token").alias("g_key"))
    lead = materialise(lead, "lead")
    bucket = lead.groupBy("g_key").agg(F.count(F.lit(1)).alias("members"))
    alone = lead.join(bucket, "g_key").select("cls", F.lit(True).alias("mixed"), "g_key", "members")
    tied = placed.where("members > 1").select("cls", F.lit(False).alias("mixed"), F.col("comp").alias("g_key"), "members").distinct()
    home = alone.union(tied).withColumn("g_block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("members") / BLOCK)).cast("int")).drop("members")
    home = materialise(home, "home")
    key = ["mixed", "g_key", "g_block"]
    own = placed.select("token", "cls", "n", "comp").join(small(home), "cls")
    group = own.groupBy("token", *key).agg(F.min("n").alias("g_lo"), F.max("n").alias("g_hi")).select("token", F.struct(*key).alias("g"), "g_lo", "g_hi")
    asker = own.select("token", "cls", "n", F.struct(*key).alias("own"))
    # of two groups, the members of the one ask the other; within a mixed group, all ask
    asks = (F.col("own") < F.col("g")) | ((F.col("own") == F.col("g")) & F.col("g.mixed"))
    asks = asks & ~((F.col("own.mixed") == F.col("g.mixed")) & ~F.col("g.mixed") & (F.col("own.g_key") == F.col("g.g_key")))
    fits = (100 * F.col("g_hi") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("g_lo"))
    meets = materialise(asker.join(group, "token").where(asks & fits).select("cls", "g.*").distinct(), "meets")
    # members of a group without any token of ``placed`` share none with an asker, so can't be similar to it
    inside = materialise(home.join(small(materialise(meets.select(*key).distinct(), "groups")), key, "left_semi"), "inside")
    wanted = sets_of(meets.select("cls").union(inside.select("cls")))
    # one row for each group: its members' sets. Each asker meets it once; the union's bound decides whether members are looked at
    rows = inside.join(wanted, "cls").groupBy(*key).agg(F.collect_list(F.struct("cls", "n", "tokens")).alias("sets"))
    rows = rows.withColumn("union", F.array_distinct(F.flatten(F.col("sets.tokens"))))
    asked = meets.join(wanted, "cls").join(rows, key)
    passes = 100 * F.size(F.array_intersect("tokens", "union")) >= percent * F.col("n")
    alike = lambda m: F.when((m["cls"] != F.col("cls")) & _size_bound(F.col("n"), m["n"], percent), _similar(F.col("n"), m["n"], F.size(F.array_intersect("tokens", m["tokens"])), percent)).otherwise(F.lit(False))
    found = F.transform(F.filter("sets", alike), lambda m: m["cls"])
    cross = asked.where(passes).select(F.col("cls").alias("a"), F.explode(F.when(F.col("mixed"), found).otherwise(F.slice(found, 1, 1))).alias("b"))
    cross = materialise(cross, "cross")

    # rows that share an id are one document
    twice = full.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("id", "a")
    same_id = full.join(twice, "id").select("a", F.col("cls").alias("b"))
    final = materialise(components(links.union(cross).union(same_id)), "final")
    named = full.join(small(final.withColumnRenamed("node", "cls")), "cls", "left").select("id", "n", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    whole = named.join(least, "root").select("id", F.col("n").alias("n_shingles"), "component_id")
    return whole.union(keys.where("n = 0").select("id", "n", "id"))
