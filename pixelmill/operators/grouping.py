"""Choosing groups of contexts, and choosers by least cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of groups that are tried (fixed values).
GROUP_COUNTS = (2, 3, 4, 6, 9, 12, 18, 27, 36)
WIDE_COUNTS = (*GROUP_COUNTS, 48, 64)


def quantile_groups(cube: DataFrame, by: Sequence[str], counts: Sequence[int]) -> DataFrame:
    """by, k, key, grp: keys in order of mean magnitude, cut greedily into at most k groups of about equal weight.

    cube: by, key, sym, cnt. One fold over the (at most some hundred) keys of each channel and k; a group closes
    when it holds its share, so fewer than k groups may come out."""
    keys = cube.groupBy(*by, "key").agg(F.sum("cnt").alias("c"), F.sum(F.abs("sym") * F.col("cnt")).alias("m"))
    packed = keys.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((F.col("m") / F.col("c")).alias("mean"), "key", "c"))).alias("keys"), F.sum("c").alias("total"))
    packed = packed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts])))
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("grp"), F.array().cast("array<struct<key:int,grp:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        acc = s["acc"] + x["c"]
        close = (acc * F.col("k") >= F.col("total")) & (s["grp"] < F.col("k") - 1)
        entry = F.struct(x["key"].cast("int").alias("key"), s["grp"].alias("grp"))
        return F.struct(F.when(close, F.lit(0).cast("long")).otherwise(acc).alias("acc"), F.when(close, s["grp"] + 1).otherwise(s["grp"]).alias("grp"), F.array_append(s["out"], entry).alias("out"))

    return packed.select(*by, "k", F.inline(F.aggregate("keys", start, step, lambda s: s["out"])))


def cheapest(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Of each group the row that is first in the order (ties need a column of their own in it)."""
    best = df.groupBy(*by).agg(F.min(F.struct(*order, *keep)).alias("x"))
    return best.select(*by, *[f"x.{c}" for c in (*order, *keep)])


def bits_for(k: Column) -> Column:
    """Bits that tell k values apart: the ceiling of log2."""
    return F.ceil(F.log2(k)).cast("int")
