"""Names, slugs and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIFFICULTIES = ("easy", "medium", "hard")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def slugify(path: Column) -> Column:
    """Lower-cased stem; runs of anything but a-z and 0-9 become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(stem(path)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))


def capitalize(s: Column) -> Column:
    return _capital(s)


def humanize(slug: Column) -> Column:
    """Hyphenated parts capitalised and set apart by blanks. An empty slug gives ''."""
    return F.array_join(F.transform(F.split(slug, "-"), _capital), " ")


def default_name(path: Column) -> Column:
    """A display name from a file name; 'My Picture' if nothing is left."""
    plain = F.trim(F.regexp_replace(stem(path), "[-_]+", " "))
    words = F.array_join(F.transform(F.split(F.regexp_replace(plain, " +", " "), " "), _capital), " ")
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("My Picture"))


def group_key(puzzle_id: Column) -> Column:
    return F.regexp_replace(puzzle_id, "-(easy|medium|hard)$", "")


def composite_key(puzzle_id: Column, mode: Column, ms: Column | None = None) -> Column:
    return F.concat_ws(":", puzzle_id, mode, *([] if ms is None else [ms.cast("string")]))
