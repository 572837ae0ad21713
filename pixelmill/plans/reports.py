"""Queries of quality, statistics and reporting, and of the run machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import costs, predictors
from ..sources import rasters
from . import base, sql

R = base.Registry()
E_TP = (sql.EMB, sql.ycocg(), sql.taps())
BY = ["img", "ch"]

_NOISY = "nz AS (SELECT img, v AS x, greatest(0, least(255, CAST(round_even(v / 5.0, 0) * 5 AS INTEGER))) AS y FROM (SELECT img, r AS v FROM emb UNION ALL SELECT img, g FROM emb UNION ALL SELECT img, b FROM emb))"


@R.add(sql.q(sql.EMB, _NOISY, "SELECT img, max(abs(x - y)) AS max_error, round(CASE WHEN sum((x - y) * (x - y)) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025.0 * count(*) / sum((x - y) * (x - y))) END, 6) AS psnr FROM nz GROUP BY img"))
def psnr_quantised(spark: SparkSession, d: str) -> DataFrame:
    """Peak signal to noise and largest error of samples rounded to multiples of 5."""
    px = rasters.pixels(rasters.embedding_raster(spark, d)).select("img", F.explode(F.array("r", "g", "b")).alias("x"))
    y = F.greatest(F.lit(0), F.least(F.lit(255), (F.rint(F.col("x") / 5) * 5).cast("int")))
    e = F.col("x") - y
    df = px.groupBy("img").agg(F.max(F.abs(e)).alias("max_error"), F.sum(e * e).alias("se"), F.count(F.lit(1)).alias("n"))
    return df.select("img", "max_error", F.round(F.when(F.col("se") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(65025 * F.col("n") / F.col("se"))), 6).alias("psnr"))


_SWEEP = f"r AS (SELECT img, v - {sql.med()} AS r FROM b4), n AS (SELECT img, CAST(t AS INTEGER) AS tau, CAST(round_even(r / CAST(2 * t + 1 AS DOUBLE), 0) AS INTEGER) AS sym, r FROM r, range(3) x(t)), hist AS (SELECT img, tau, sym, count(*) AS cnt FROM n GROUP BY ALL), er AS (SELECT img, tau, max(abs(r - sym * (2 * tau + 1))) AS max_error, CAST(sum((r - sym * (2 * tau + 1)) * (r - sym * (2 * tau + 1))) AS BIGINT) AS se FROM n GROUP BY ALL)"


@R.add(sql.q(*E_TP, _SWEEP, sql.huffman("img, tau"), "SELECT img, tau, huff + 16 + 24 * alphabet AS bits, round((huff + 16 + 24 * alphabet) / CAST(n AS DOUBLE), 6) AS bpp, max_error, se FROM hf JOIN er USING (img, tau)"))
def rate_distortion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Rate and error of open-loop quantisation at tau 0, 1 and 2."""
    df = base.med_residuals(spark, d).groupBy("img", "r").agg(F.count(F.lit(1)).alias("cnt"))
    df = df.select("img", "r", "cnt", F.explode(F.array(*map(F.lit, range(3)))).alias("tau")).withColumn("sym", F.rint(F.col("r") / (2 * F.col("tau") + 1)).cast("int"))
    e = F.col("r") - F.col("sym") * (2 * F.col("tau") + 1)
    errors = df.groupBy("img", "tau").agg(F.max(F.abs(e)).alias("max_error"), F.sum(e * e * F.col("cnt")).alias("se"))
    bits = costs.huffman_bits(df.groupBy("img", "tau", "sym").agg(F.sum("cnt").alias("cnt")), ["img", "tau"])
    return bits.join(errors, ["img", "tau"]).select("img", "tau", F.col("stream").alias("bits"), F.round(F.col("stream") / F.col("n"), 6).alias("bpp"), "max_error", "se")


_TWO = f"l1 AS (SELECT img, CAST(sum(abs(v - {sql.med()})) AS BIGINT) AS x, CAST(sum(abs(v - ((a + b) >> 1))) AS BIGINT) AS y FROM b4 GROUP BY ALL), df AS (SELECT img, x - y AS d FROM l1 WHERE x <> y), rk AS (SELECT d, avg(o) OVER (PARTITION BY abs(d)) AS r FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS o FROM df))"


def _two_scores(spark: SparkSession, d: str) -> DataFrame:
    """img, x, y: total errors of two predictors on every image (an image has one row)."""
    a, b, c = map(F.col, "abc")
    df = base.taps(spark, d)
    return df.groupBy("img").agg(F.sum(F.abs(F.col("v") - predictors.med(a, b, c))).alias("x"), F.sum(F.abs(F.col("v") - color.half(a + b))).alias("y"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """n, w and p of the exact two-sided signed-rank test of pairs (x, y): zeros go, ties share ranks, and the shares of
    the 2^n sign patterns with each rank sum are built up rank by rank (in double precision).

    One task has all differences, and one cell for each rank sum up to the smaller one: time grows with the cube of n."""
    packed = pairs.select((F.col("x") - F.col("y")).alias("d")).filter("d <> 0").agg(F.collect_list(F.col("d").cast("double")).alias("ds"))

    def run(batches):
        for b in batches:
            for ds in map(np.array, b.column("ds").to_pylist()):
                if len(ds):
                    size, order = np.abs(ds), np.sort(np.abs(ds))
                    # twice the average rank, so that all stays integer
                    r2 = np.searchsorted(order, size) + np.searchsorted(order, size, "right") + 1
                    plus = int(r2[ds > 0].sum())
                    least = min(plus, int(r2.sum()) - plus)
                    share = np.zeros(least + 1)
                    share[0] = 1
                    for r in r2.tolist():
                        drawn = share / 2
                        drawn[r:] += share[: max(0, len(share) - r)] / 2
                        share = drawn
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(ds)], pa.int32()), "w": [least / 2], "p": [min(1.0, 2 * float(share.sum()))]})

    return packed.mapInArrow(run, "n int, w double, p double")


_RANKS = """ri AS (SELECT CAST(2 * r AS BIGINT) AS r2, d, row_number() OVER (ORDER BY abs(d), d) AS k FROM rk),
tt AS (SELECT count(*) AS n, CAST(sum(r2) AS BIGINT) AS t, CAST(sum(CASE WHEN d > 0 THEN r2 ELSE 0 END) AS BIGINT) AS w FROM ri),
pt AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(t + 1), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM tt
  UNION ALL SELECT ri.k, list_transform(range(len(c)), lambda s: c[s + 1] / 2 + CASE WHEN s >= r2 THEN c[s - r2 + 1] / 2 ELSE 0 END) FROM pt JOIN ri ON ri.k = pt.k + 1)"""


@R.add(sql.q(*E_TP, _TWO, _RANKS, "SELECT CAST(n AS INTEGER) AS n, least(w, t - w) / 2.0::DOUBLE AS w, least(1.0, 2 * list_sum(c[1:least(w, t - w) + 1])) AS p FROM pt, tt WHERE k = n AND n > 0"))
def wilcoxon_signed_rank(spark: SparkSession, d: str) -> DataFrame:
    return wilcoxon(_two_scores(spark, d))


@R.add(sql.q(*E_TP, _TWO, "SELECT count(*) FILTER (WHERE x < y) AS wins, count(*) FILTER (WHERE x > y) AS losses, count(*) FILTER (WHERE x = y) AS ties FROM l1"))
def wins_and_losses(spark: SparkSession, d: str) -> DataFrame:
    return _two_scores(spark, d).agg(F.count_if(F.col("x") < F.col("y")).alias("wins"), F.count_if(F.col("x") > F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


@R.add(sql.q(*E_TP, f"hist AS (SELECT img, ch, v - {sql.med()} AS sym, count(*) AS cnt FROM b4 GROUP BY ALL)", sql.huffman("img, ch"), "t AS (SELECT img, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits, CAST(sum(n) AS BIGINT) AS n FROM hf GROUP BY img)", "SELECT coalesce(CAST(img AS VARCHAR), 'AVG') AS img, round(avg(bits / CAST(n AS DOUBLE)), 6) AS bpp FROM t GROUP BY ROLLUP (img)"))
def bpp_report(spark: SparkSession, d: str) -> DataFrame:
    """Bits per sub-pixel of every image, and their mean."""
    bits = costs.huffman_bits(costs.histogram(base.med_residuals(spark, d), BY), BY)
    per = bits.groupBy("img").agg((F.sum("stream") / F.sum("n")).alias("bpp"))
    return per.rollup("img").agg(F.round(F.avg("bpp"), 6).alias("bpp")).select(F.coalesce(F.col("img").cast("string"), F.lit("AVG")).alias("img"), "bpp")


@R.add(sql.q(sql.EMB, "SELECT img, count(*) AS pixels, true AS equal FROM emb GROUP BY img"))
def round_trip_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding what was encoded gives the raster again, by digests of both."""
    px = rasters.pixels(rasters.embedding_raster(spark, d))
    back = color.ycocg_inverse(*color.ycocg(*map(F.col, "rgb")))
    here, there = F.bit_xor(F.xxhash64("i", "j", "r", "g", "b")), F.bit_xor(F.xxhash64("i", "j", *back))
    return px.groupBy("img").agg(F.count(F.lit(1)).alias("pixels"), (here == there).alias("equal"))


@R.add(sql.q(sql.EMB, "SELECT img, 3 AS runs, 1 AS digests FROM emb GROUP BY img"))
def determinism(spark: SparkSession, d: str) -> DataFrame:
    """Digests of three evaluations of one query."""
    once = lambda k: base.med_residuals(spark, d).groupBy("img").agg(F.bit_xor(F.xxhash64("ch", "i", "j", "r")).alias("h")).withColumn("run", F.lit(k))
    return once(0).unionAll(once(1)).unionAll(once(2)).groupBy("img").agg(F.count(F.lit(1)).cast("int").alias("runs"), F.count_distinct("h").cast("int").alias("digests"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), "fl AS (SELECT img, ch, i, j, v, a, (a = b AND b = c AND c = d AND NOT (i = 0 AND j = 0) AND j + 1 < 64) AS flat FROM b4), ct AS (SELECT img, ch, i, j, v, flat, a, v = a AS same FROM fl), rm AS (SELECT img, ch, i, 0 AS j, 0 AS runs, 0 AS covered, 0 AS regular, false AS forced, false AS inrun FROM ct WHERE j = 0), st AS (SELECT * FROM rm UNION ALL SELECT s.img, s.ch, s.i, s.j + 1, s.runs + (NOT s.inrun AND NOT s.forced AND c.flat)::INT, s.covered + ((s.inrun OR (NOT s.forced AND c.flat)) AND c.same)::INT, s.regular + (NOT ((s.inrun OR (NOT s.forced AND c.flat)) AND c.same))::INT, false, ((s.inrun OR (NOT s.forced AND c.flat)) AND c.same) FROM st s JOIN ct c ON c.img = s.img AND c.ch = s.ch AND c.i = s.i AND c.j = s.j)", "SELECT img, ch, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(regular) AS BIGINT) AS regular FROM st WHERE j = 64 GROUP BY ALL"))
def run_machine(spark: SparkSession, d: str) -> DataFrame:
    """Runs in flat neighbourhoods: where all neighbours are equal a run (perhaps empty) of samples equal to the left one
    is coded, and then one regular sample without a new test. Rows are independent folds."""
    df = base.taps(spark, d, "evt")
    a, b, c, dd = map(F.col, "abcd")
    flat = (a == b) & (b == c) & (c == dd) & ~((F.col("i") == 0) & (F.col("j") == 0))
    rows = df.groupBy(*BY, "i").agg(F.array_sort(F.collect_list(F.struct("j", flat.alias("flat"), (F.col("v") == a).alias("same")))).alias("p"))
    # no run begins at the last sample of a row
    rows = rows.withColumn("p", F.transform("p", lambda x, k: x.withField("flat", x["flat"] & (k + 1 < F.size("p")))))
    start = F.struct(F.lit(False).alias("inrun"), F.lit(0).alias("runs"), F.lit(0).alias("covered"), F.lit(0).alias("regular"))

    def step(s, x):
        on = s["inrun"] | x["flat"]
        take = on & x["same"]
        return F.struct(take.alias("inrun"), (s["runs"] + (~s["inrun"] & x["flat"]).cast("int")).alias("runs"), (s["covered"] + take.cast("int")).alias("covered"), (s["regular"] + (~take).cast("int")).alias("regular"))

    return rows.select(*BY, F.aggregate("p", start, step).alias("x")).groupBy(*BY).agg(F.sum("x.runs").alias("runs"), F.sum("x.covered").alias("covered"), F.sum("x.regular").alias("regular"))
