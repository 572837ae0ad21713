"""Predictor banks as projections over causal neighbours, and their unpivoting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import floor_div, half
from .neighbors import shifted, stacked


def _c(name: str) -> Column:
    return F.col(name)


def med(a: Column, b: Column, c: Column) -> Column:
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(c >= hi, lo).when(c <= lo, hi).otherwise(a + b - c)


def paeth(a: Column, b: Column, c: Column) -> Column:
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def gap(threshold: int) -> Column:
    a, b, c, d, ww, nne = map(_c, ("a", "b", "c", "d", "ww", "nne"))
    horizontal = F.abs(a - ww) + F.abs(b - c) + F.abs(b - d)
    vertical = F.abs(a - c) + F.abs(b - nne) + F.abs(d - b)
    step = vertical - horizontal
    return F.when(step > threshold, a).when(step < -threshold, b).otherwise(half(a + b) + floor_div(d - c, 4))


def bank() -> dict[str, Column]:
    """The sixteen experts in their order (ties go to the first)."""
    a, b, c, d = map(_c, "abcd")
    return {
        "MED": med(a, b, c), "TOP": b, "LEFT": a, "PAETH": paeth(a, b, c), "GRAD": half(a + b) + floor_div(b - c, 4), "GAP80": gap(80), "DG": half(c + d), "AVG_AB": half(a + b),
        "PLANE": a + b - c, "GAP32": gap(32), "AC": half(a + c), "C": c, "BC": half(b + c), "D": d, "GAP16": gap(16), "AVG3": floor_div(a + b + c, 3),
    }


#: The first, small bank (fixed values).
SMALL_BANK = ("MED", "TOP", "LEFT", "PAETH", "GRAD", "GAP80")


def micro() -> dict[str, Column]:
    a, b, c, d = map(_c, "abcd")
    four, five = F.array_sort(F.array(a, b, c, d)), F.array_sort(F.array(a, b, c, d, half(a + b)))
    return {"MEDIAN4": half(F.get(four, F.lit(1)) + F.get(four, F.lit(2))), "MEDIAN5": F.get(five, F.lit(2)), "GAP8": gap(8), "GAP4": gap(4), "AVG4": floor_div(a + b + c + d, 4)}


def graded_gap() -> Column:
    """Gradient-adjusted prediction that leans to a side between the thresholds 32 and 80."""
    a, b, c, d, ww, nne = map(_c, ("a", "b", "c", "d", "ww", "nne"))
    step = F.abs(a - c) + F.abs(b - nne) + F.abs(d - nne) - F.abs(a - ww) - F.abs(b - c) - F.abs(b - d)
    base = half(a + b) + floor_div(d - c, 4)
    return F.when(step > 80, a).when(step < -80, b).when(step > 32, half(base + a)).when(step < -32, half(base + b)).otherwise(base)


def unpivoted(taps: DataFrame, experts: dict[str, Column], keep: Sequence[str] = ("img", "ch", "i", "j", "v")) -> DataFrame:
    """keep, expert, ord (its place in the order) and p (its prediction): one row per sample and expert."""
    cells = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(n).alias("expert"), x.cast("int").alias("p")) for k, (n, x) in enumerate(experts.items())])
    return taps.select(*keep, F.inline(cells))


def med_rows(planes: DataFrame) -> DataFrame:
    """Median-edge residuals (copied borders) of planes (img, ch, i, row), made within the row arrays: samples are never rows."""
    df = stacked(planes, 1)

    def residual(v: Column, j: Column) -> Column:
        left, top = F.get("row", j - 1), F.get("u1", j)
        return v - med(F.coalesce(left, top, F.lit(0)), F.coalesce(top, left, F.lit(0)), F.coalesce(F.get("u1", j - 1), left, top, F.lit(0)))

    return df.select("img", "ch", "i", F.transform("row", residual).alias("row"))


def med_samples(rgb: DataFrame, convert) -> DataFrame:
    """(img, ch, r): median-edge residuals (copied borders) of the three channels of an RGB row table; convert(r, g, b) gives a
    pixel's channels. A pixel and its three neighbours are converted after rows are taken apart, as scalars."""
    w, size = Window.partitionBy("img").orderBy("i"), F.size("r")
    above = rgb.select("img", "r", "g", "b", *[F.lag(c).over(w).alias(f"u{c}") for c in "rgb"])
    shifts = {"v": ("", 0), "l": ("", -1), "t": ("u", 0), "tl": ("u", -1)}
    columns = {f"{n}_{c}": shifted(F.col(f"{up}{c}"), size, right) for n, (up, right) in shifts.items() for c in "rgb"}
    zipped = above.select("img", *[x.alias(n) for n, x in columns.items()]).select("img", F.explode(F.arrays_zip(*columns)).alias("p"))
    # one projection a step, so that no expression is written out several times
    df = zipped.select("img", *[F.col(f"p.{n}").alias(n) for n in columns])
    df = df.select("img", *[x.cast("int").alias(f"{n}{k}") for n in shifts for k, x in enumerate(convert(*[F.col(f"{n}_{c}") for c in "rgb"]))])
    left, top, corner = ([F.col(f"{n}{k}") for k in range(3)] for n in ("l", "t", "tl"))
    zero = F.lit(0)
    made = {"a": lambda k: F.coalesce(left[k], top[k], zero), "b": lambda k: F.coalesce(top[k], left[k], zero), "c": lambda k: F.coalesce(corner[k], left[k], top[k], zero)}
    df = df.select("img", *[F.col(f"v{k}") for k in range(3)], *[f(k).alias(f"{n}{k}") for n, f in made.items() for k in range(3)])
    df = df.select("img", *[(F.col(f"v{k}") - med(F.col(f"a{k}"), F.col(f"b{k}"), F.col(f"c{k}"))).alias(f"r{k}") for k in range(3)])
    return df.select("img", F.posexplode(F.array("r0", "r1", "r2")).alias("ch", "r"))
