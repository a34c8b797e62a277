"""Colour algebra as column expressions: sRGB bytes, CIELAB (D65) and hexadecimal colours.

Values are computed as doubles and stored as floats, stage by stage. Rounding is floor(x + 0.5).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White point, matrices and thresholds of the conversion.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
PRESETS = ["#e6194b", "#f58231", "#ffe119", "#bfef45", "#3cb44b", "#42d4f4", "#4363d8", "#911eb4", "#f032e6", "#a9a9a9", "#000000", "#ffffff"]


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def linear(byte: Column) -> Column:
    """A byte of sRGB as linear light (float)."""
    c = byte.cast("double") / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))).cast("float")


def cube_root_or_line(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)


def cube_or_line(t: Column) -> Column:
    cube = t * t * t
    return F.when(cube > 0.008856, cube).otherwise((t - 16 / 116) / 7.787)


def lab(r: Column, g: Column, b: Column) -> Column:
    """Struct (l, a, b) of floats."""
    rgb = [linear(c).cast("double") for c in (r, g, b)]
    fx, fy, fz = (cube_root_or_line(sum(k * c for k, c in zip(row, rgb, strict=True)) / w) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return F.struct((116 * fy - 16).cast("float").alias("l"), (500 * (fx - fy)).cast("float").alias("a"), (200 * (fy - fz)).cast("float").alias("b"))


def srgb_byte(c: Column) -> Column:
    """Linear light as a byte, clamped."""
    v = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return F.least(F.lit(255), F.greatest(F.lit(0), round_half_up(v * 255))).cast("int")


def rgb(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Array of three bytes of a Lab colour."""
    fy = (l + 16) / 116
    xyz = [cube_or_line(t) * w for t, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True)]
    return F.array(*(srgb_byte(sum(k * c for k, c in zip(row, xyz, strict=True))) for row in TO_RGB))


def hex_of(bytes3: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(F.get(bytes3, F.lit(k))), 2, "0")) for k in range(3)))


def lab_hex(l: Column, a: Column, b: Column, boost: float = 1.0) -> Column:  # noqa: E741
    """#rrggbb of a Lab colour whose chroma is multiplied by ``boost``."""
    return hex_of(rgb(l, a * boost, b * boost))


def hex_rgb(h: Column) -> Column:
    return F.array(*(F.conv(F.substring(h, k, 2), 16, 10).cast("int") for k in (2, 4, 6)))


def hex_lab(h: Column) -> Column:
    c = hex_rgb(h)
    return lab(*(F.get(c, F.lit(k)) for k in range(3)))


def distance_sq(p: Column, q: Column) -> Column:
    """Squared colour difference of two (l, a, b) structs, as doubles."""
    d = [p[k].cast("double") - q[k].cast("double") for k in ("l", "a", "b")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
