"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of links (a, b); root is the smallest vertex of v's component.

    Each round reads and writes a table of at most one row per link; the number of rounds grows with the
    logarithm of the largest component's diameter. Joins are on vertices, where the side of the minima has
    one row per vertex, so that a hub's rows can be split."""
    e = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct(), "links")
    seen = None
    for _ in range(rounds):
        # large star: every neighbour above u is linked to the smallest of u and its neighbours
        both = e.unionAll(e.select(F.col("m").alias("v"), F.col("v").alias("m"))).select(F.col("v").alias("u"), F.col("m").alias("w"))
        low = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("low"))
        large = both.filter("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).filter("v <> m").distinct()
        # small star: the neighbours below v, and v, are linked to the smallest of them
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("x")).select("x.*").filter("v <> m").distinct()
        e = written(small, "links")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m"))).first()
        if seen == now:
            break
        seen = now
    else:
        raise ValueError("components did not settle")
    return e.select("v", F.col("m").alias("root")).unionAll(e.select(F.col("m").alias("v"), F.col("m").alias("root")).distinct())
