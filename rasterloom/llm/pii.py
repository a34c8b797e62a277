"""Personal data: pattern spans, and identifiers found by bootstrapped contextual extraction. DataFrame functions only.

The validated spans of four kinds are seeds. Tokens that look like identifiers (those with a digit or an @) and overlap no base span are
the other instances. Seeds and instances stand in lexical patterns (see ``patterns_of``); a pattern-instance graph joins
both. Rounds go over the graph: known values give patterns their confidence, patterns of high confidence, with several known values,
make their other instances known, which counts in the next round, until a round adds nothing (see ``bootstrap``). All occurrences of the
values found are new spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import find, per_document

KINDS = ["email", "ip", "card", "phone"]
# The patterns, with possessive loops and run starts written out so that they need no backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Tokens that look like identifiers: runs with a digit or an @.
TOKEN = r"(?<![\p{L}\p{N}@._%+-])[\p{L}._%+-]*+[0-9@][\p{L}\p{N}@._%+-]*[\p{L}\p{N}]"
PRIOR = 1.0


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.zip_with(d, F.sequence(F.lit(0), F.length(digits) - 1), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, 2 * x.cast("int") - 9).otherwise(2 * x.cast("int")))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Valid spans of the four kinds: (key, kind, start, end, value, before, after)."""
    t = F.col("t")
    gates = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][ -]?[0-9]"), "phone": t.contains("+")}
    found = find(docs, {k: (gates[k], PATTERNS[k]) for k in KINDS}, id_col, text_col, t.rlike("[0-9@]"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card = F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    valid = F.when(F.col("kind") == "ip", ip).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(True))
    return found.where(valid)


def _order() -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))


def shape(value: Column) -> Column:
    """Letters as a (a run is one), digits as 9, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")


def patterns_of(value: Column, before: Column, after: Column) -> Column:
    """The lexical patterns that an identifier stands in: two words before it, two words after it, one word before and one after, and the
    word before or after with the identifier's shape. Words are lower-cased; what isn't a letter parts them."""
    left = F.filter(F.split(F.lower(before), r"[^\p{L}]+"), lambda w: w != "")
    right = F.filter(F.split(F.lower(after), r"[^\p{L}]+"), lambda w: w != "")
    l1, l2, r1, r2 = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.get(right, 0), F.get(right, 1)
    kinds = [F.concat(F.lit("ll "), l2, F.lit(" "), l1), F.concat(F.lit("rr "), r1, F.lit(" "), r2), F.concat(F.lit("lr "), l1, F.lit(" "), r1), F.concat(F.lit("ls "), l1, F.lit(" "), shape(value)), F.concat(F.lit("rs "), r1, F.lit(" "), shape(value))]
    return F.array_compact(F.array(*kinds))


def apart(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of ``spans`` that overlap none of ``taken`` in the same document: both are cut at blocks of 64 characters, so only
    neighbours meet. Both have key, start and end."""
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))))
    held = cells(taken.select("key", "start", "end").distinct()).select("key", "cell", F.col("start").alias("b0"), F.col("end").alias("b1"))
    clash = cells(spans.select("key", "start", "end").distinct()).join(held, ["key", "cell"]).where("start < b1 and b0 < end").select("key", "start", "end").distinct()
    return spans.join(clash, ["key", "start", "end"], "left_anti")


def bootstrap(seeds: DataFrame, seen: DataFrame, least: float, support: int) -> DataFrame:
    """(kind, value, score) of the values of ``seen`` that are taken for identifiers.

    ``seeds``: (kind, value, pattern), ``seen``: (value, pattern), both distinct. Each round: patterns in which at least ``support`` known
    values of a kind stand have as confidence the sum of the scores of these over the number of all values in the pattern, plus
    ``PRIOR``; values of ``seen`` with a pattern of at least ``least`` confidence become known, with that confidence as their score and the kind of
    their best pattern (ties: as the kinds are listed). Seeds score 1. The rounds end when nothing is added."""
    every = materialise(seeds.select("value", "pattern").union(seen).distinct(), "graph")
    known = materialise(seeds.select("kind", "value").distinct().withColumn("s", F.lit(1.0)), "known")
    found, have = None, -1
    while True:
        held = every.join(known, "value").groupBy("kind", "pattern").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= support)
        good = materialise(held, "patterns")
        size = every.join(good.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        sure = good.join(size, "pattern").withColumn("c", F.col("s") / (F.col("n") + PRIOR)).where(F.col("c") >= least)
        best = seen.join(sure, "pattern").groupBy("value").agg(F.max(F.struct(F.col("c"), (-_order()).alias("o"), F.col("kind"))).alias("b"))
        new = best.select(F.col("b.kind").alias("kind"), "value", F.col("b.c").alias("s"))
        if found is not None:  # what is known stays known, with its kind and first score
            new = found.unionByName(new.join(found, "value", "left_anti"))
        found = materialise(new, "found")
        n = found.count()
        if n <= max(have, 0):
            return found
        have = n
        known = seeds.select("kind", "value").distinct().withColumn("s", F.lit(1.0)).union(found)


def contextual_spans(docs: DataFrame, base: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, support: int = 3) -> DataFrame:
    """New spans (key, kind, start, end): tokens outside all base spans that are the value of one elsewhere or that ``bootstrap`` takes for
    identifiers."""
    digit = F.col("t").rlike("[0-9@]")
    loose = find(docs, {"any": (digit, TOKEN)}, id_col, text_col, digit).where(F.length("value") >= 4).select("key", "start", "end", "value", "before", "after")
    seen = materialise(apart(materialise(loose, "tokens"), base), "instances")
    patterns = lambda d: F.explode(patterns_of(F.col("value"), F.col("before"), F.col("after"))).alias("pattern")
    seeds = materialise(base.select("kind", "value", patterns(base)).distinct(), "seeds")
    known = base.groupBy("value").agg(F.min_by("kind", _order()).alias("kind")).select("kind", "value")
    free = seen.join(known, "value", "left_anti")
    found = bootstrap(seeds, materialise(free.select("value", patterns(free)).distinct(), "edges"), least, support)
    return seen.join(found.select("kind", "value").union(known), "value").select("key", "kind", "start", "end").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: id_col, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans (text).

    Null and empty texts have no spans; long texts are looked at whole. Repeated rows get equal results; so do equal texts under a null id. Other
    columns are ignored. An empty table gives no rows. Without any seed no pattern arises and spans equal base_spans."""
    base = materialise(base_spans(docs, id_col, text_col), "pii")
    new = contextual_spans(docs, base, id_col, text_col)
    spans = materialise(base.select("key", "kind", "start", "end", F.lit(True).alias("is_base")).union(new.select("key", "kind", "start", "end", F.lit(False))), "pii-spans")
    return per_document(docs, spans, KINDS, id_col, text_col)
