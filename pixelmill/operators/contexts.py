"""Context keys derived from causal neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Five thresholds each that cut the local energy into six groups (fixed values).
ENERGY_GRIDS = ((4, 12, 28, 60, 120), (2, 6, 16, 40, 100), (8, 24, 64, 160, 400), (1, 3, 8, 24, 80), (3, 9, 20, 48, 110), (6, 18, 44, 100, 220), (1, 2, 5, 16, 48), (5, 15, 36, 80, 160))


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def energy9(a: Column, b: Column, c: Column) -> Column:
    return F.least(F.shiftright(F.abs(a - c) + F.abs(b - c), 4), F.lit(8))


def level(x: Column, thresholds) -> Column:
    """How many of the thresholds are below x."""
    return sum((F.when(x > t, 1).otherwise(0) for t in thresholds), F.lit(0))


def gradient_level(g: Column) -> Column:
    """A gradient's signed level -4..4, with steps at 0, 2, 7 and 21."""
    size = level(F.abs(g), (0, 2, 7, 21))
    return F.when(g < 0, -size).otherwise(size)


def loco(taps: DataFrame) -> DataFrame:
    """taps with q1, q2, q3, key (0..728, sign-normalised) and sgn."""
    a, b, c, d = _c("a", "b", "c", "d")
    df = taps.withColumns({"q1": gradient_level(b - c), "q2": gradient_level(c - a), "q3": gradient_level(d - b)})
    q1, q2, q3 = _c("q1", "q2", "q3")
    negative = (q1 < 0) | ((q1 == 0) & ((q2 < 0) | ((q2 == 0) & (q3 < 0))))
    df = df.withColumn("sgn", F.when(negative, -1).otherwise(1))
    s = F.col("sgn")
    return df.withColumn("key", s * q1 * 81 + s * q2 * 9 + s * q3)


def activity(taps: DataFrame) -> Column:
    """Bin of |L - TL| + |T - TL| at 4, 12 and 48 (left and top stand in for each other)."""
    left, top, tl = _c("left", "top", "topleft")
    x = F.abs(left - tl) + F.abs(top - tl)
    return sum((F.when(x >= t, 1).otherwise(0) for t in (4, 12, 48)), F.lit(0))


def tier(q1: Column, q2: Column, q3: Column) -> Column:
    """Sum of the three gradient levels, 8 at most."""
    return F.least(F.abs(q1) + F.abs(q2) + F.abs(q3), F.lit(8))


def flat(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a == b) & (b == c) & (c == d)


def cell(i: Column, j: Column, height: int, width: int, n: int) -> Column:
    """Which of n x n parts of the image a sample is in."""
    return F.expr("0") + (F.floor(i * n / height) * n + F.floor(j * n / width)).cast("int")


def block(i: Column, j: Column, size: int, width: int) -> Column:
    across = -(-width // size)
    return (F.floor(i / size) * across + F.floor(j / size)).cast("int")
