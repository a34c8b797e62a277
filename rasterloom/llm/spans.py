"""Spans of patterns in whole texts, in DataFrame functions only.

Spark's expressions give matched strings but not where they stand. Here each match is set between two private-use characters,
the text is split at these, and lengths of what lies before are summed in a window over the rows of a document. That is
linear in the text and the number of matches, and only matches are shuffled.

Offsets count code points; an end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key

OPEN, CLOSE, PLAIN = "", "", "￼"
TAIL, HEAD = 80, 40


def find(docs: DataFrame, patterns: dict[str, tuple[Column, str]], id_col: str = "doc_id", text_col: str = "text", gate: Column | None = None) -> DataFrame:
    """(key, kind, start, end, value, before, after) of the leftmost non-overlapping matches, kind by kind.

    ``patterns``: kind -> (cheap condition on the column ``t`` that any match implies, Java pattern). ``gate``: a condition on
    ``t`` that any match of any kind implies. ``before`` and ``after`` hold up to 80 and 40 characters around the match, of what lies
    between it and its neighbours of the same kind. Null texts have no match. Repeated rows share a key and are looked at once.
    Patterns must not match the two private-use characters U+E000 and U+E001; a text may hold them."""
    raw = F.col(text_col)
    src = docs.where(raw.isNotNull()).select(row_key(id_col, raw).alias("key"), raw.alias("t"))
    if gate is not None:
        src = src.where(gate)
    src = src.withColumn("t", F.when(F.col("t").rlike(f"[{OPEN}{CLOSE}]"), F.translate("t", OPEN + CLOSE, PLAIN * 2)).otherwise(F.col("t")))
    cut = lambda p: F.split(F.regexp_replace("t", p, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(cond, cut(p)).alias("p")) for k, (cond, p) in patterns.items()))
    parts = src.select("key", F.explode(kinds).alias("k")).select("key", "k.kind", F.col("k.p").alias("p")).where(F.size("p") > 1)
    at = F.transform(
        F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)),
        lambda i: F.struct(i.alias("no"), F.length(F.get("p", i - 1)).alias("gap"), F.get("p", i).alias("value"), F.right(F.get("p", i - 1), F.lit(TAIL)).alias("before"), F.left(F.get("p", i + 1), F.lit(HEAD)).alias("after")),
    )
    rows = parts.select("key", "kind", F.explode(at).alias("m")).select("key", "kind", "m.*")
    rows = rows.repartition("key").dropDuplicates(["key", "kind", "no"])
    run = Window.partitionBy("key", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(run)
    return rows.withColumn("end", end).select("key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after")


def digest(order: list[str]) -> Column:
    """Aggregate: the spans of a group as 'kind:start:end', by start, then kind as listed, then end; comma-joined."""
    place = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(order)), F.lit(len(order)))
    item = F.struct(F.col("start"), place.alias("o"), F.col("end"), F.col("kind"))
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_set(item)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def per_document(docs: DataFrame, spans: DataFrame, base: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: id_col, n_<kind> for the kinds of ``base``, base_spans and spans as text.

    ``spans``: (key, kind, start, end, is_base). Documents without spans have zeros and empty strings."""
    counts = [F.count_if((F.col("kind") == k) & F.col("is_base")).alias(f"n_{k}") for k in base]
    rows = spans.groupBy("key").agg(*counts, digest(base).alias("spans"))
    own = spans.where("is_base").groupBy("key").agg(digest(base).alias("base_spans"))
    r = rows.join(own, "key", "left").select(F.col("key.id").alias("r_id"), F.col("key.h").alias("r_h"), F.col("key.n").alias("r_n"), *(f"n_{k}" for k in base), "base_spans", "spans")
    keys = docs.select(row_key(id_col, F.col(text_col)).alias("key"))
    joined = keys.join(r, F.col("key.id").eqNullSafe(F.col("r_id")) & F.col("key.h").eqNullSafe(F.col("r_h")) & F.col("key.n").eqNullSafe(F.col("r_n")), "left")
    return joined.select(F.col("key.id").alias(id_col), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base), F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))
