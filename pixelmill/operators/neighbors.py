"""Causal neighbours of every sample.

One window per image and channel brings the two or three rows above beside each row (as arrays); horizontal
neighbours are array lookups. So a raster is shuffled once, as rows, whatever the number of taps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name: (rows up, columns to the right)
TAPS = {"l": (0, -1), "l2": (0, -2), "l3": (0, -3), "t": (1, 0), "tl": (1, -1), "tr": (1, 1), "tl2": (1, -2), "tr2": (1, 2), "t2": (2, 0), "t3": (3, 0)}


def stacked(planes: DataFrame, up: int = 2) -> DataFrame:
    """planes with u1..u<up>: the rows above."""
    w = Window.partitionBy("img", "ch").orderBy("i")
    return planes.select("*", *[F.lag("row", k).over(w).alias(f"u{k}") for k in range(1, up + 1)])


def shifted(row: Column, size: Column, right: int) -> Column:
    """The array of the samples `right` columns to the right of each (null beyond the ends). row: an array, or null for none."""
    none = F.array().cast("array<int>")
    whole = F.coalesce(row, none)
    if right >= 0:
        return F.slice(whole, right + 1, size)
    return F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), -right), whole), 1, size)


def raw_taps(planes: DataFrame, names: Sequence[str] = ("l", "l2", "t", "t2", "tl", "tr"), extra: Sequence[str] = ()) -> DataFrame:
    """(img, ch, i, j, v) and the named taps, null outside the raster. extra: array columns that go along, element by element.

    Rows are shifted as arrays and taken apart together, so that no expression runs over elements inside a row."""
    up = max(TAPS[n][0] for n in names)
    df = stacked(planes, up) if up else planes
    size = F.size("row")
    source = lambda n: F.col("row") if n == 0 else F.col(f"u{n}")
    columns = {"v": F.col("row")} | {n: shifted(source(TAPS[n][0]), size, TAPS[n][1]) for n in names} | {x: F.col(x) for x in extra}
    df = df.select("img", "ch", "i", *[x.alias(n) for n, x in columns.items()])
    cells = df.select("img", "ch", "i", F.posexplode(F.arrays_zip(*columns)).alias("j", "x"))
    return cells.select("img", "ch", "i", "j", *[F.col(f"x.{n}").alias(n) for n in columns])


def edge_copied(taps: DataFrame) -> DataFrame:
    """The doctrine of copied borders: a (left), b (top), c (top left), d (top right), ww, nne."""
    a, b = F.coalesce("l", "t", F.lit(0)), F.coalesce("t", "l", F.lit(0))
    made = {"a": a, "b": b, "c": F.coalesce("tl", "l", "t", F.lit(0)), "d": F.coalesce("tr", F.when(F.col("i") == 0, a).otherwise(b)), "ww": F.coalesce("l2", a), "nne": F.coalesce("t2", b)}
    return taps.withColumns({k: v.cast("int") for k, v in made.items()}).drop(*TAPS)


def corner_zero(taps: DataFrame) -> DataFrame:
    """Left and top stand in for each other; top left and top right are 0 outside."""
    made = {"left": F.coalesce("l", "t", F.lit(0)), "top": F.coalesce("t", "l", F.lit(0)), "topleft": F.coalesce("tl", F.lit(0)), "topright": F.coalesce("tr", F.lit(0))}
    return taps.withColumns({k: v.cast("int") for k, v in made.items()})


def all_zero(taps: DataFrame) -> DataFrame:
    """Every tap outside is 0."""
    return taps.fillna(0, [n for n in TAPS if n in taps.columns])
