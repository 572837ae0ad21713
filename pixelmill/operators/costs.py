"""Exact code lengths of symbol histograms.

Samples are reduced to (group..., sym, cnt) first; every cost below is a function of that table alone, so its
work follows the number of distinct symbols. Folds run over one group's counts, sorted, as an array (at most
the alphabet's size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import zigzag


def histogram(residuals: DataFrame, by: Sequence[str], sym: str = "r") -> DataFrame:
    return residuals.groupBy(*by, F.col(sym).cast("int").alias("sym")).agg(F.count(F.lit(1)).alias("cnt"))


def huffman_fold(counts: Column, single: Column | None = None) -> Column:
    """Total bits of an optimal prefix code for an array of counts: the two smallest merge until one is left.

    The two-queue form: sorted leaves in one queue, merged weights (which grow) in the other; each step takes the
    two smallest heads. single: the bits of an alphabet of one symbol (else its count)."""
    leaves = F.transform(F.array_sort(counts), lambda x: x.cast("long"))
    n = F.size(leaves)
    far = F.lit((1 << 62)).cast("long")
    start = F.struct(leaves.alias("leaf"), F.array().cast("array<long>").alias("made"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("bits"))
    head = lambda q, i: F.coalesce(F.get(q, i), far)

    def step(s: Column, _: Column) -> Column:
        l0, l1, m0, m1 = head(s["leaf"], s["i"]), head(s["leaf"], s["i"] + 1), head(s["made"], s["j"]), head(s["made"], s["j"] + 1)
        two_leaves, two_made = l1 <= m0, m1 < l0
        total = F.when(two_leaves, l0 + l1).when(two_made, m0 + m1).otherwise(l0 + m0)
        di = F.when(two_leaves, 2).when(two_made, 0).otherwise(1)
        return F.struct(s["leaf"].alias("leaf"), F.array_append(s["made"], total).alias("made"), (s["i"] + di).alias("i"), (s["j"] + 2 - di).alias("j"), (s["bits"] + total).alias("bits"))

    folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["bits"])
    one = F.get(leaves, F.lit(0)) if single is None else single
    return F.when(n == 0, F.lit(0).cast("long")).when(n == 1, one.cast("long")).otherwise(folded)


def huffman_bits(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n (symbols), alphabet, huff (data bits) and stream (with 16 bits and 24 a table entry)."""
    df = hist.groupBy(*by).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("alphabet"), F.collect_list("cnt").alias("counts"))
    df = df.withColumn("huff", huffman_fold(F.col("counts"))).drop("counts")
    return df.withColumn("stream", F.col("huff") + 16 + 24 * F.col("alphabet"))


def entropy_bits(hist: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    """by, n, alphabet and entropy: n * H in bits, rounded."""
    n = F.col("n")
    df = hist.groupBy(*by).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("alphabet"), F.sum(F.col("cnt") * F.log2("cnt")).alias("x"))
    return df.withColumn("entropy", F.round(n * F.log2(n) - F.col("x"), digits)).drop("x")


def golomb_by_k(hist: DataFrame, by: Sequence[str], mapped: Column | None = None, most: int = 12) -> DataFrame:
    """by, k and bits of Golomb-Rice codes for k = 0..most: each symbol takes (M >> k) + 1 + k bits. One pass over the counts."""
    m = zigzag(F.col("sym")) if mapped is None else mapped
    df = hist.withColumn("m", m.cast("long")).groupBy(*by).agg(*[F.sum(F.col("cnt") * (F.shiftright("m", k) + 1 + k)).alias(f"k{k}") for k in range(most + 1)])
    return df.select(*by, F.posexplode(F.array(*[f"k{k}" for k in range(most + 1)])).alias("k", "bits"))


def golomb_best(hist: DataFrame, by: Sequence[str], mapped: Column | None = None, most: int = 12) -> DataFrame:
    """by, k and bits: the least bits, ties to the least k."""
    best = golomb_by_k(hist, by, mapped, most).groupBy(*by).agg(F.min(F.struct("bits", "k")).alias("x"))
    return best.select(*by, "x.k", "x.bits")


def golomb_biased(hist: DataFrame, by: Sequence[str], biases: Sequence[int] = (-4, -3, -2, -1, 1, 2, 3)) -> DataFrame:
    """by, d, k and bits: without a bias bits + 4; with one bits + 7, taken if strictly less; earlier biases first."""
    shifts = [(0, 0), *((n + 1, d) for n, d in enumerate(biases))]
    wide = hist.select(*by, "cnt", F.inline(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(d).alias("d"), (F.col("sym") - d).alias("sym")) for o, d in shifts])))
    each = golomb_best(wide, [*by, "ord", "d"]).withColumn("bits", F.col("bits") + F.when(F.col("ord") == 0, 4).otherwise(7))
    best = each.groupBy(*by).agg(F.min(F.struct("bits", "ord", "d", "k")).alias("x"))
    return best.select(*by, "x.d", "x.k", "x.bits")


def three_costs(hist: DataFrame, by: Sequence[str], most: int = 12) -> DataFrame:
    """by, n, alphabet, huff, stream, k, golomb and entropy from one aggregation of the counts."""
    m = zigzag(F.col("sym")).cast("long")
    sums = [F.sum(F.col("cnt") * (F.shiftright("m", k) + 1 + k)).alias(f"k{k}") for k in range(most + 1)]
    df = hist.withColumn("m", m).groupBy(*by).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("alphabet"), F.collect_list("cnt").alias("counts"), F.sum(F.col("cnt") * F.log2("cnt")).alias("x"), *sums)
    best = F.array_min(F.array(*[F.struct(F.col(f"k{k}").alias("bits"), F.lit(k).alias("k")) for k in range(most + 1)]))
    df = df.select(*by, "n", "alphabet", huffman_fold(F.col("counts")).alias("huff"), best.alias("g"), F.round(F.col("n") * F.log2("n") - F.col("x"), 4).alias("entropy"))
    return df.select(*by, "n", "alphabet", "huff", (F.col("huff") + 16 + 24 * F.col("alphabet")).alias("stream"), "g.k", F.col("g.bits").alias("golomb"), "entropy")


def rice_by_mean(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, k and bits: k is the floor of log2 of the mean magnitude of nonzero symbols, within 0..8."""
    df = hist.withColumn("m", zigzag(F.col("sym")).cast("long")).groupBy(*by).agg(F.sum(F.when(F.col("sym") != 0, F.abs("sym") * F.col("cnt")).otherwise(0)).alias("s"), F.sum(F.when(F.col("sym") != 0, F.col("cnt")).otherwise(0)).alias("nz"), *[F.sum(F.col("cnt") * (F.shiftright("m", k) + 1 + k)).alias(f"k{k}") for k in range(9)])
    # floor(log2(s / nz)) without a logarithm: powers of two that the mean reaches
    k = sum((F.when(F.col("s") >= F.col("nz") * (1 << p), 1).otherwise(0) for p in range(1, 9)), F.lit(0))
    df = df.withColumn("k", F.when(F.col("nz") > 0, k).otherwise(0))
    return df.select(*by, "k", F.get(F.array(*[f"k{p}" for p in range(9)]), F.col("k")).alias("bits"))


def gamma_bits(n: Column) -> Column:
    """Bits of the Elias gamma code of n >= 1."""
    return 2 * (F.length(F.bin(n)) - 1) + 1


def rans_frequencies(hist: DataFrame, by: Sequence[str], scale: int = 1 << 14) -> DataFrame:
    """by, sym, cnt, freq and cum: frequencies that sum to scale; what rounding leaves goes to the first symbol of the largest count."""
    w, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("cnt").over(w)
    df = hist.withColumn("f", F.greatest(F.lit(1).cast("long"), F.expr("0L") + F.floor((F.col("cnt") * scale + F.floor(total / 2)) / total)))
    first = F.row_number().over(w.orderBy(F.desc("cnt"), "sym"))
    df = df.withColumn("rest", F.lit(scale) - F.sum("f").over(w)).withColumn("nth", first)
    df = df.withColumn("freq", F.col("f") + F.when(F.col("nth") == 1, F.col("rest")).otherwise(0))
    return df.select(*by, "sym", "cnt", "freq", F.coalesce(F.sum("freq").over(order), F.lit(0)).cast("long").alias("cum"))


def canonical_codes(lengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, sym, len and code: canonical codes in the order (len, sym), from a running sum of Kraft shares."""
    w = Window.partitionBy(*by)
    most = F.max("len").over(w)
    df = lengths.withColumn("most", most).withColumn("share", F.expr("shiftleft(1L, most - len)"))
    before = F.coalesce(F.sum("share").over(w.orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before.cast("long")).select(*by, "sym", "len", F.expr("shiftright(before, most - len)").alias("code"))
