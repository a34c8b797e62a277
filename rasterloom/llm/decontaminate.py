"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

The windows of an item are its runs of ``size`` words (the whole item if it has fewer). Containment of a window is asked
in full, so one word of it is a sufficient prefix: its rarest one by corpus frequency. Words of the documents join that
prefix; the positional bound (the window must fit around that word) and the length bound come next, then the window is
compared word by word.

Only words of the benchmark are ever counted or joined. The prefix side is broadcast if its counted rows stay within
``BROADCAST_ROWS``; beyond, both sides are shuffled by word: of the documents only words that are some window's prefix, each with its
surroundings (such words are rare by choice; they are told by a broadcast of the distinct ones, if these are few enough).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, materialise, row_key, small

#: Runs of characters that are no word character: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def count_words(text: Column) -> Column:
    """The number of ``words_of`` a text. Splitting is much the cheapest way: regexp_count keeps a match object for every word."""
    return F.size(words_of(text))


def windows_of(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(window, items): each distinct window with the set of items that hold it."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    return w.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Occurrences of windows: (key, start, len, item). ``key`` is the row key of the document; ``start`` is the position
    of the first word, from 0. An item id that is null names no item. Repeated rows of documents share a key."""
    windows = materialise(windows_of(items.where(F.col(item_col).isNotNull()), size, item_col, item_text_col), "windows")
    doc_words = docs.select(row_key(id_col, F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("w"))
    vocab = windows.select(F.explode("window").alias("word")).distinct()
    few = windows.limit(broadcast_rows + 1).count() <= broadcast_rows
    vocab = small(materialise(vocab, "vocabulary"), broadcast_rows)
    # rarity: how often the corpus holds each benchmark word
    seen = doc_words.select(F.explode("w").alias("word")).join(vocab, "word").groupBy("word").count()
    freq = materialise(seen, "word-frequency")
    placed = windows.select("window", "items", F.posexplode("window").alias("at", "word")).join(freq, "word", "left")
    rank = F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")
    prefix = placed.groupBy("window").agg(F.min(rank).alias("r"), F.first("items").alias("items")).where("r.n > 0")
    prefix = prefix.select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), "window", F.size("window").alias("len"), "items")
    if few:
        prefix = F.broadcast(prefix)
        cut = F.slice(F.col("w"), F.col("pos") - F.col("at") + 1, F.col("len"))
        pairs = doc_words.select("key", "w", F.posexplode("w").alias("pos", "word")).join(prefix, "word")
        fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("len") <= F.size("w"))
    else:
        known = doc_words.select("key", "w", F.posexplode("w").alias("pos", "word"))
        prefix = materialise(prefix, "prefixes")
        used = prefix.select("word").distinct()
        if used.limit(broadcast_rows + 1).count() <= broadcast_rows:
            known = known.join(F.broadcast(used), "word", "left_semi")
        first = F.greatest(F.col("pos") - size + 1, F.lit(0))
        near = known.select("key", "pos", "word", first.alias("first"), F.slice("w", first + 1, 2 * size - 1).alias("w"))
        pairs = near.join(prefix, "word")
        start = F.col("pos") - F.col("at") - F.col("first")
        fits = (F.col("pos") >= F.col("at")) & (start + F.col("len") <= F.size("w"))
        cut = F.slice(F.col("w"), start + 1, F.col("len"))
    found = pairs.where(fits).where(F.when(fits, cut) == F.col("window"))
    return found.select("key", (F.col("pos") - F.col("at")).alias("start"), "len", "items")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document row: ``id_col``, n_words, n_hit (words inside any window found), items (sorted array of
    the items found).

    Null or empty texts have no words and no hits. Ties between equally rare prefix words go to the smaller word. Repeated
    rows are returned as often as they come, with equal results. Extra columns are ignored."""
    found = materialise(hits(docs, items, size, id_col, text_col, item_col, item_text_col, broadcast_rows), "hits")
    inside = found.select("key", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    marks = inside.join(named, "key")
    m = marks.select(F.col("key.id").alias("m_id"), F.col("key.h").alias("m_h"), F.col("key.n").alias("m_n"), "n_hit", "items")
    base = docs.select(row_key(id_col, F.col(text_col)).alias("key"), count_words(F.col(text_col)).cast("long").alias("n_words"))
    joined = base.join(m, F.col("key.id").eqNullSafe(F.col("m_id")) & (F.col("key.h") == F.col("m_h")) & (F.col("key.n").eqNullSafe(F.col("m_n"))), "left")
    return joined.select(F.col("key.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
