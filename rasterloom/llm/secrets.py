"""Secrets: pattern spans, and multipart credentials linked by an interval join. DataFrame functions only.

Besides the three base kinds, three weak kinds are looked for, each of which means little alone: identifiers of accounts
(part_id), strings that may be keys (part_key) and endpoints (part_endpoint). A weak part is reported only if a
complementary part stands within ``SCOPE`` characters of it in the same document: a key needs an identifier or an endpoint, an
identifier needs a key or a base secret, an endpoint needs both an identifier and a key. Base spans serve as complements:
access keys as identifiers, assignments and hexadecimal strings as keys. Complements never overlap: of overlapping spans only the kind that
comes first in ``ORDER`` takes part, so the path of a URL is no key.

The interval join is by cells of ``SCOPE`` characters: each part is in the cells that it covers; a weak part meets, in its own cells and the two on
either side, the least start and greatest end of every other role. That is exact, and linear in the length of the parts, however many
stand in one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import find, per_document

KINDS = ["assign", "access", "hex"]
WEAK = ["part_id", "part_key", "part_endpoint"]
#: Which of overlapping spans is linked.
ORDER = ["access", "assign", "hex", "part_endpoint", "part_id", "part_key"]
SCOPE = 200
# The patterns.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
NAME = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
PART_ID = r"(?i:client_?id|account_?id|user_?name|login|key_?id)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._@-]{3,}+"
PART_KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}"
PART_ENDPOINT = r"(?:https?|wss?|amqps?|postgres|mysql|redis|mongodb)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]++"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and weak parts: (key, kind, start, end)."""
    t = F.col("t")
    named = t.rlike(r"(?i)passw|secret|token|api_?key")
    kinds = {"assign": (named, ASSIGN), "access": (t.contains("AKIA"), ACCESS), "hex": (t.rlike(r"[0-9a-f]{24}"), HEX), "part_id": (t.rlike(r"(?i)_?(?:id|name|login)[\"']?\x20*[:=]"), PART_ID), "part_key": (t.rlike(r"[A-Za-z0-9+/_-]{20}"), PART_KEY), "part_endpoint": (t.contains("://"), PART_ENDPOINT)}
    found = find(docs, kinds, id_col, text_col)
    v = F.col("value")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    valid = F.when(F.col("kind") == "assign", F.length(F.regexp_replace("value", NAME, "")) >= 6).when(F.col("kind") == "part_key", mixed).otherwise(F.lit(True))
    return found.where(valid).select("key", "kind", "start", "end")


def _role(kind: Column) -> Column:
    return F.when(kind.isin("access", "part_id"), "id").when(kind.isin("assign", "hex", "part_key"), "key").otherwise("endpoint")


def disjoint(spans: DataFrame) -> DataFrame:
    """The rows of (key, kind, start, end) that overlap none of a kind before their own in ``ORDER``. So no text vouches for itself as two
    parts. Blocks of 64 characters bring together what can overlap."""
    place = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ORDER)))
    cells = spans.withColumn("place", place).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))))
    other = cells.select("key", "cell", F.col("place").alias("p0"), F.col("start").alias("b0"), F.col("end").alias("b1"))
    clash = cells.join(other, ["key", "cell"]).where("p0 < place and start < b1 and b0 < end").select("key", "kind", "start", "end").distinct()
    return spans.join(clash, ["key", "kind", "start", "end"], "left_anti")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of disjoint spans (key, kind, start, end) that have their complements within ``scope`` characters, from the end of the one
    to the start of the other."""
    cell = lambda at: F.floor(at / scope)
    roles = spans.withColumn("role", _role(F.col("kind")))
    held = roles.withColumn("near", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    bounds = held.groupBy("key", "near", F.col("role").alias("other")).agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    weak = roles.where(F.col("kind").isin(*WEAK)).withColumn("near", F.explode(F.sequence(cell(F.col("start")) - 2, cell(F.col("end") - 1) + 2)))
    met = weak.join(bounds, ["key", "near"]).where(F.col("other") != F.col("role"))
    # a cell to the left is judged by the greatest end in it, one to the right by the least start; what shares a cell with the part is near
    inside = F.when(F.col("near") < cell(F.col("start")), F.col("hi") >= F.col("start") - scope).when(F.col("near") > cell(F.col("end") - 1), F.col("lo") <= F.col("end") + scope).otherwise(F.lit(True))
    has = met.where(inside).groupBy("key", "kind", "role", "start", "end").agg(F.collect_set("other").alias("others"))
    enough = F.when(F.col("role") == "key", F.size("others") >= 1).when(F.col("role") == "id", F.array_contains("others", "key")).otherwise(F.size("others") == 2)
    return has.where(enough).select("key", "kind", "start", "end")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: id_col, n_assign, n_access, n_hex (base spans), base_spans and spans (text).

    Of overlapping parts only the first kind in ``ORDER`` is linked. Null and empty texts have no spans; long texts are looked at whole. Repeated
    rows get equal results; so do equal texts under a null id. Other columns are ignored. An empty table gives no rows."""
    found = materialise(candidates(docs, id_col, text_col), "secrets")
    base = found.where(F.col("kind").isin(*KINDS))
    parts = materialise(disjoint(found), "parts")
    spans = base.withColumn("is_base", F.lit(True)).union(linked(parts).withColumn("is_base", F.lit(False)))
    return per_document(docs, materialise(spans, "secret-spans"), KINDS, id_col, text_col)
