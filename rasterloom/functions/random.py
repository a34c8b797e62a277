"""The seeded 32-bit generator of the palettes as a column: its state grows by a constant, so the k-th number follows from k alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, BITS = 0x6D2B79F5, 0xFFFFFFFF  # fixed value: what the state grows by


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, in halves, as the whole would exceed a bigint."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(BITS))


def random32(seed: Column, k: Column) -> Column:
    """The number at place k (from 0) of the generator with this seed (a bigint of 0 or more), in [0, 1)."""
    a = (seed.cast("bigint") + (k.cast("bigint") + 1) * F.lit(STEP).cast("bigint")).bitwiseAND(F.lit(BITS))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1).cast("bigint")))
    mixed = t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))
    u = t.bitwiseXOR(mixed.bitwiseAND(F.lit(BITS)))
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)
