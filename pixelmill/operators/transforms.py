"""Integer block and lifting transforms over rows of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import floor_div, half

#: The 4 x 4 integer cosine core (fixed values).
DCT4 = ((1, 1, 1, 1), (2, 1, -1, -2), (1, -1, -1, 1), (1, -2, 2, -1))


def lift_rows(planes: DataFrame) -> DataFrame:
    """img, ch, i, s, d: the 5/3 lifting of every row (low and high halves), with mirrored ends. Rows are arrays: no shuffle."""
    n = F.size("row")
    odd = F.floor(n / 2)
    even = n - odd
    at = lambda k: F.get("row", k)
    detail = F.transform(F.slice(F.sequence(F.lit(0), odd), 1, odd.cast("int")), lambda k: at(2 * k + 1) - half(at(2 * k) + at(F.least(2 * k + 2, 2 * (even - 1)))))
    df = planes.withColumn("d", detail)
    high = lambda k: F.coalesce(F.get("d", F.greatest(F.lit(0), F.least(k, odd - 1))), F.lit(0))
    smooth = F.transform(F.sequence(F.lit(0), even - 1), lambda k: at(2 * k) + floor_div(high(k - 1) + high(k) + 2, 4))
    return df.select("img", "ch", "i", smooth.alias("s"), "d")


def unlift_rows(lifted: DataFrame) -> DataFrame:
    """The rows that lift_rows() came from."""
    odd, even = F.size("d"), F.size("s")
    high = lambda k: F.coalesce(F.get("d", F.greatest(F.lit(0), F.least(k, odd - 1))), F.lit(0))
    df = lifted.withColumn("e", F.transform("s", lambda x, k: x - floor_div(high(k - 1) + high(k) + 2, 4)))
    back = F.transform("d", lambda x, k: x + half(F.get("e", k) + F.get("e", F.least(k + 1, even - 1))))
    df = df.withColumn("o", back)
    return df.select("img", "ch", "i", F.transform(F.sequence(F.lit(0), odd + even - 1), lambda j: F.when(j % 2 == 0, F.get("e", half(j))).otherwise(F.get("o", half(j)))).alias("row"))


def transposed(planes: DataFrame) -> DataFrame:
    """planes with rows and columns exchanged."""
    cells = planes.select("img", "ch", "i", F.posexplode("row").alias("j", "v"))
    return cells.groupBy("img", "ch", F.col("j").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("row"))


def blocks(planes: DataFrame, size: int) -> DataFrame:
    """img, ch, bi, bj, s: whole size x size blocks as arrays in raster order. Rows are cut in place; only block rows meet."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("row") / size) - 1), lambda k: F.struct(k.cast("int").alias("bj"), F.slice("row", (k * size + 1).cast("int"), size).alias("part")))
    rows = planes.filter(F.size("row") >= size).select("img", "ch", F.floor(F.col("i") / size).cast("int").alias("bi"), "i", F.inline(cut))
    packed = rows.groupBy("img", "ch", "bi", "bj").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("p")).filter(F.size("p") == size)
    return packed.select("img", "ch", "bi", "bj", F.flatten("p.part").alias("s"))


def dct4(s: str = "s") -> Column:
    """The forward transform of a 4 x 4 block: sixteen sums with constant weights."""
    out = []
    for u in range(4):
        for v in range(4):
            out.append(sum((F.get(s, F.lit(4 * i + j)) * (DCT4[u][i] * DCT4[v][j]) for i in range(4) for j in range(4)), F.lit(0)))
    return F.array(*out)


def dct4_inverse(y: str = "y") -> Column:
    """The exact inverse: rows of the core are orthogonal with norms 4, 10, 4, 10, so weights have the denominator 400."""
    weight = (100, 40, 100, 40)
    out = []
    for i in range(4):
        for j in range(4):
            total = sum((F.get(y, F.lit(4 * u + v)).cast("long") * (DCT4[u][i] * DCT4[v][j] * weight[u] * weight[v]) for u in range(4) for v in range(4)), F.lit(0).cast("long"))
            out.append((total / (400 * 400)).cast("int"))
    return F.array(*out)
