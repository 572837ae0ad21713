"""Queries over code lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import contexts, costs, predictors
from ..sources import rasters
from . import base, sql

R = base.Registry()
E_TP = (sql.EMB, sql.ycocg(), sql.taps())
RES = f"rs AS (SELECT *, v - {sql.med()} AS r FROM b4)"
HIST = "hist AS (SELECT img, ch, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL)"
E_H = (*E_TP, RES, HIST)


def med_histogram(spark: SparkSession, d: str, source: str = "emb") -> DataFrame:
    return costs.histogram(base.residual_samples(spark, d, source), ("img", "ch"))


_BEST_K = sql.first("gk", "img, ch", "bits, k", "gb")


@R.add(sql.q(*E_H, sql.huffman("img, ch"), sql.golomb("img, ch"), _BEST_K, "en AS (SELECT img, ch, round(sum(cnt) * log2(sum(cnt)) - sum(cnt * log2(cnt)), 4) AS entropy FROM hist GROUP BY ALL)", "SELECT img, ch, hf.n, hf.alphabet, hf.huff, hf.huff + 16 + 24 * hf.alphabet AS stream, gb.k, gb.bits AS golomb, entropy, round((hf.huff + 16 + 24 * hf.alphabet) / CAST(hf.n AS DOUBLE), 6) AS bpp FROM hf JOIN gb USING (img, ch) JOIN en USING (img, ch)"))
def bpp_med_order0(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: bits per sub-pixel of median-edge residuals under three coders, by image and channel."""
    df = costs.three_costs(med_histogram(spark, d), ["img", "ch"])
    return df.withColumn("bpp", F.round(F.col("stream") / F.col("n"), 6))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), RES, HIST, sql.huffman("img, ch"), "SELECT img, ch, n, alphabet, huff, huff + 16 + 24 * alphabet AS stream FROM hf"))
def huffman_events(spark: SparkSession, d: str) -> DataFrame:
    return costs.huffman_bits(med_histogram(spark, d, "evt"), ["img", "ch"])


@R.add(sql.q(sql.DOC, "hist AS (SELECT img, v AS sym, count(*) AS cnt FROM doc GROUP BY ALL)", sql.huffman("img"), "SELECT img, n, alphabet, huff, huff + 16 + 24 * alphabet AS stream FROM hf"))
def huffman_documents(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.document_plane(spark, d).select("img", F.explode("row").alias("r"))
    return costs.huffman_bits(costs.histogram(px, ["img"]), ["img"])


@R.add(sql.q(*E_TP, RES, "hist AS (SELECT img, ch, least((abs(a - c) + abs(b - c)) >> 4, 8) AS e, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL)", sql.huffman("img, ch, e"), "SELECT img, ch, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits, count(*) AS tables FROM hf GROUP BY ALL"))
def huffman_by_energy(spark: SparkSession, d: str) -> DataFrame:
    """Nine tables a channel, by energy class."""
    df = base.med_residuals(spark, d).withColumn("e", contexts.energy9(F.col("a"), F.col("b"), F.col("c")))
    return costs.huffman_bits(costs.histogram(df, ["img", "ch", "e"]), ["img", "ch", "e"]).groupBy("img", "ch").agg(F.sum("stream").alias("bits"), F.count(F.lit(1)).alias("tables"))


@R.add(sql.q(*E_H, sql.huffman("img, ch"), "SELECT img, ch, CASE WHEN alphabet = 1 THEN 0 ELSE huff END AS zero_if_single, CASE WHEN alphabet = 1 THEN n + 40 ELSE huff END AS mlp_rule, huff + 16 + 48 * alphabet AS pair_table FROM hf"))
def huffman_variants(spark: SparkSession, d: str) -> DataFrame:
    one = F.col("alphabet") == 1
    df = costs.huffman_bits(med_histogram(spark, d), ["img", "ch"])
    return df.select("img", "ch", F.when(one, 0).otherwise(F.col("huff")).alias("zero_if_single"), F.when(one, F.col("n") + 40).otherwise(F.col("huff")).alias("mlp_rule"), (F.col("huff") + 16 + 48 * F.col("alphabet")).alias("pair_table"))


@R.add(sql.q(*E_H, "SELECT img, ch, round(sum(cnt) * log2(sum(cnt)) - sum(cnt * log2(cnt)), 4) AS entropy, round(sum(cnt) * log2(sum(cnt)) - sum(cnt * log2(cnt)), 4) + 16 + 32 * count(*) AS rans_proxy FROM hist GROUP BY ALL"))
def entropy_and_proxy(spark: SparkSession, d: str) -> DataFrame:
    df = costs.entropy_bits(med_histogram(spark, d), ["img", "ch"])
    return df.select("img", "ch", "entropy", (F.col("entropy") + 16 + 32 * F.col("alphabet")).alias("rans_proxy"))


@R.add(sql.q(*E_TP, RES, "p AS (SELECT img, ch, r, lag(r) OVER (PARTITION BY img, ch, i ORDER BY j) AS q FROM rs), x AS (SELECT img, ch, q, r, count(*) AS cnt FROM p WHERE q IS NOT NULL GROUP BY ALL), y AS (SELECT img, ch, q, sum(cnt) AS m, sum(cnt * log2(cnt)) AS s FROM x GROUP BY ALL)", "SELECT img, ch, round(sum(m * log2(m)) - sum(s), 3) AS h1 FROM y GROUP BY ALL"))
def conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Bits of a residual given the one to its left."""
    w = Window.partitionBy("img", "ch", "i").orderBy("j")
    pairs = base.med_residuals(spark, d).select("img", "ch", "r", F.lag("r").over(w).alias("q")).filter("q is not null")
    x = pairs.groupBy("img", "ch", "q", "r").agg(F.count(F.lit(1)).alias("cnt"))
    y = x.groupBy("img", "ch", "q").agg(F.sum("cnt").alias("m"), F.sum(F.col("cnt") * F.log2("cnt")).alias("s"))
    return y.groupBy("img", "ch").agg(F.round(F.sum(F.col("m") * F.log2("m")) - F.sum("s"), 3).alias("h1"))


@R.add(sql.q(*E_H, sql.golomb("img, ch"), "SELECT img, ch, k, bits FROM gk"))
def golomb_all_k(spark: SparkSession, d: str) -> DataFrame:
    return costs.golomb_by_k(med_histogram(spark, d), ["img", "ch"])


_SHIFT = "sh AS (SELECT img, ch, ord, d, sym - d AS sym, cnt FROM hist, (VALUES (0, 0), (1, -4), (2, -3), (3, -2), (4, -1), (5, 1), (6, 2), (7, 3)) x(ord, d))"


@R.add(sql.q(*E_H, _SHIFT, sql.golomb("img, ch, ord, d", "sh"), sql.first("gk", "img, ch, ord", "bits, k", "g1"), sql.first("(SELECT img, ch, ord, d, k, bits + CASE WHEN ord = 0 THEN 4 ELSE 7 END AS bits FROM g1)", "img, ch", "bits, ord", "g2"), "SELECT img, ch, d, k, bits FROM g2"))
def golomb_with_bias(spark: SparkSession, d: str) -> DataFrame:
    return costs.golomb_biased(med_histogram(spark, d), ["img", "ch"])


@R.add(sql.q(*E_H, "m AS (SELECT img, ch, sum(CASE WHEN sym <> 0 THEN abs(sym) * cnt ELSE 0 END) AS s, sum(CASE WHEN sym <> 0 THEN cnt ELSE 0 END) AS nz FROM hist GROUP BY ALL), kk AS (SELECT img, ch, CASE WHEN nz = 0 THEN 0 ELSE greatest(0, least(8, CAST(floor(log2(CAST(s AS DOUBLE) / nz)) AS INTEGER))) END AS k FROM m)", f"SELECT img, ch, k, CAST(sum(cnt * (({sql.ZIGZAG} >> k) + 1 + k)) AS BIGINT) AS bits FROM hist JOIN kk USING (img, ch) GROUP BY ALL"))
def rice_from_mean(spark: SparkSession, d: str) -> DataFrame:
    return costs.rice_by_mean(med_histogram(spark, d), ["img", "ch"])


@R.add(sql.q(*E_TP, sql.LOCO, f"hist AS (SELECT img, ch, key, sgn * (v - {sql.med()}) AS sym, count(*) AS cnt FROM lk GROUP BY ALL)", sql.golomb("img, ch, key"), sql.first("gk", "img, ch, key", "bits, k", "gb"), "SELECT img, ch, CAST(sum(bits) AS BIGINT) AS bits, count(*) AS keys, CAST(sum(k) AS BIGINT) AS k_sum FROM gb GROUP BY ALL"))
def golomb_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A parameter of its own for each gradient key."""
    df = contexts.loco(base.taps(spark, d)).withColumn("r", F.col("sgn") * (F.col("v") - predictors.med(F.col("a"), F.col("b"), F.col("c"))))
    best = costs.golomb_best(costs.histogram(df, ["img", "ch", "key"]), ["img", "ch", "key"])
    return best.groupBy("img", "ch").agg(F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("keys"), F.sum("k").alias("k_sum"))


_FREQ = """fr0 AS (SELECT *, greatest(1, CAST((cnt * 16384 + sum(cnt) OVER w // 2) // sum(cnt) OVER w AS BIGINT)) AS f FROM hist WINDOW w AS (PARTITION BY img, ch)),
fr1 AS (SELECT *, 16384 - sum(f) OVER (PARTITION BY img, ch) AS rest, row_number() OVER (PARTITION BY img, ch ORDER BY cnt DESC, sym) AS nth FROM fr0),
fr AS (SELECT img, ch, sym, cnt, CAST(f + CASE WHEN nth = 1 THEN rest ELSE 0 END AS BIGINT) AS freq FROM fr1)"""


@R.add(sql.q(*E_H, _FREQ, "SELECT *, CAST(coalesce(sum(freq) OVER (PARTITION BY img, ch ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM fr"))
def rans_frequency_table(spark: SparkSession, d: str) -> DataFrame:
    return costs.rans_frequencies(med_histogram(spark, d), ["img", "ch"])


@R.add("SELECT CAST(n AS BIGINT) AS n, CAST(2 * floor(log2(n)) + 1 AS INTEGER) AS bits FROM range(1, 1001) t(n)")
def elias_gamma(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 1001).select(F.col("id").alias("n"), costs.gamma_bits(F.col("id")).alias("bits"))


_RUNS = """o AS (SELECT img, ch, r, i * 64 + j AS pos, row_number() OVER (PARTITION BY img, ch ORDER BY i, j) AS rn, row_number() OVER (PARTITION BY img, ch, r = 0 ORDER BY i, j) AS rz FROM rs),
z AS (SELECT img, ch, rn - rz AS isle, count(*) AS len FROM o WHERE r = 0 GROUP BY ALL)"""


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), RES, HIST, _RUNS, "m AS (SELECT img, ch, sum(CASE WHEN sym <> 0 THEN abs(sym) * cnt ELSE 0 END) AS s, sum(CASE WHEN sym <> 0 THEN cnt ELSE 0 END) AS nz FROM hist GROUP BY ALL), kk AS (SELECT img, ch, CASE WHEN nz = 0 THEN 0 ELSE greatest(0, least(8, CAST(floor(log2(CAST(s AS DOUBLE) / nz)) AS INTEGER))) END AS k FROM m)", f"SELECT img, ch, k, CAST(coalesce((SELECT sum(2 * floor(log2(len)) + 2) FROM z WHERE z.img = h.img AND z.ch = h.ch), 0) AS BIGINT) AS run_bits, CAST(sum(CASE WHEN sym <> 0 THEN cnt * (({sql.ZIGZAG} >> k) + 2 + k) ELSE 0 END) AS BIGINT) AS value_bits FROM hist h JOIN kk USING (img, ch) GROUP BY img, ch, k"))
def rice_with_zero_runs(spark: SparkSession, d: str) -> DataFrame:
    """Flag and gamma code for runs of zeros, flag and Rice code for the rest."""
    res = base.med_residuals(spark, d, "evt")
    w = Window.partitionBy("img", "ch").orderBy("i", "j")
    isles = res.select("img", "ch", "r", (F.row_number().over(w) - F.sum((F.col("r") == 0).cast("int")).over(w)).alias("isle")).filter("r = 0")
    runs = isles.groupBy("img", "ch", "isle").agg(F.count(F.lit(1)).alias("len")).groupBy("img", "ch").agg(F.sum(costs.gamma_bits(F.col("len")) + 1).alias("run_bits"))
    hist = costs.histogram(res, ("img", "ch"))
    rice = costs.rice_by_mean(hist, ["img", "ch"]).select("img", "ch", "k")
    values = hist.join(rice, ["img", "ch"]).groupBy("img", "ch", "k").agg(F.sum(F.when(F.col("sym") != 0, F.col("cnt") * (F.expr("shiftright(cast((case when sym >= 0 then 2 * sym else -2 * sym - 1 end) as bigint), k)") + 2 + F.col("k"))).otherwise(0)).alias("value_bits"))
    return values.join(runs, ["img", "ch"], "left").select("img", "ch", "k", F.coalesce("run_bits", F.lit(0)).alias("run_bits"), "value_bits")


@R.add(sql.q(*E_H, sql.huffman("img, ch"), sql.golomb("img, ch"), _BEST_K, sql.first("(SELECT img, ch, huff + 16 + 24 * alphabet AS bits, 0 AS o, 'huffman' AS coder FROM hf UNION ALL SELECT img, ch, bits + 4, 1, 'golomb' FROM gb UNION ALL SELECT img, ch, n * 9, 2, 'raw' FROM hf)", "img, ch", "bits, o", "b"), "SELECT img, ch, coder, bits FROM b"))
def channel_coder_choice(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest of Huffman, Golomb and raw nine-bit coding."""
    by = ["img", "ch"]
    df = costs.three_costs(med_histogram(spark, d), by)
    cells = F.array(F.struct(F.col("stream").alias("bits"), F.lit(0).alias("o"), F.lit("huffman").alias("coder")), F.struct((F.col("golomb") + 4).alias("bits"), F.lit(1).alias("o"), F.lit("golomb").alias("coder")), F.struct((F.col("n") * 9).alias("bits"), F.lit(2).alias("o"), F.lit("raw").alias("coder")))
    return df.select(*by, F.array_min(cells).alias("x")).select(*by, "x.coder", "x.bits")


_CRES = f"cr AS (SELECT img, i, j, max(CASE WHEN ch = 1 THEN v - {sql.med()} END) AS rco, max(CASE WHEN ch = 2 THEN v - {sql.med()} END) AS rcg FROM b4 GROUP BY ALL)"


@R.add(sql.q(*E_TP, _CRES, "hist AS (SELECT img, rco, rcg, count(*) AS cnt FROM cr GROUP BY ALL)", sql.huffman("img"), "SELECT img, n, alphabet, huff + 16 + 48 * alphabet AS bits FROM hf"))
def chroma_pair_alphabet(spark: SparkSession, d: str) -> DataFrame:
    """One code for both chroma residuals."""
    res = base.med_residuals(spark, d)
    px = res.groupBy("img", "i", "j").agg(F.max(F.when(F.col("ch") == 1, F.col("r"))).alias("rco"), F.max(F.when(F.col("ch") == 2, F.col("r"))).alias("rcg"))
    hist = px.groupBy("img", "rco", "rcg").agg(F.count(F.lit(1)).alias("cnt"))
    return costs.huffman_bits(hist, ["img"]).select("img", "n", "alphabet", (F.col("huff") + 16 + 48 * F.col("alphabet")).alias("bits"))


@R.add(sql.q(*E_TP, sql.experts(), "m AS (SELECT img, ch, i, j, min(abs(v - p)) AS best FROM ex GROUP BY ALL), h AS (SELECT img, ch, best, count(*) AS cnt FROM m GROUP BY ALL)", "SELECT img, ch, round(sum(cnt) * log2(sum(cnt)) - sum(cnt * log2(cnt)), 4) AS entropy, CAST(sum(best * cnt) AS BIGINT) AS l1 FROM h GROUP BY ALL"))
def oracle_bank(spark: SparkSession, d: str) -> DataFrame:
    """A bound: the best expert of every sample, as if known."""
    df = base.taps(spark, d)
    best = F.array_min(F.array(*[F.abs(F.col("v") - x) for x in predictors.bank().values()]))
    hist = df.groupBy("img", "ch", best.cast("int").alias("sym")).agg(F.count(F.lit(1)).alias("cnt"))
    x = hist.groupBy("img", "ch").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log2("cnt")).alias("s"), F.sum(F.col("sym") * F.col("cnt")).alias("l1"))
    return x.select("img", "ch", F.round(F.col("n") * F.log2("n") - F.col("s"), 4).alias("entropy"), "l1")


@R.add(sql.q(*E_H, sql.first("hist", "img, ch", "cnt DESC, sym", "top"), "SELECT h.img, h.ch, count(*) AS symbols, CAST(sum(h.cnt) AS BIGINT) AS n, round(sum(abs(h.sym) * h.cnt) / CAST(sum(h.cnt) AS DOUBLE), 6) AS mean_abs, min(top.sym) AS mode FROM hist h JOIN top USING (img, ch) GROUP BY ALL"))
def residual_summary(spark: SparkSession, d: str) -> DataFrame:
    hist = med_histogram(spark, d)
    out = hist.groupBy("img", "ch").agg(F.count(F.lit(1)).alias("symbols"), F.sum("cnt").alias("n"), F.sum(F.abs("sym") * F.col("cnt")).alias("s"), F.max(F.struct("cnt", (-F.col("sym")).alias("m"))).alias("x"))
    return out.select("img", "ch", "symbols", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean_abs"), (-F.col("x.m")).alias("mode"))


@R.add(sql.q(*E_H, "t AS (SELECT *, row_number() OVER (PARTITION BY img, ch ORDER BY cnt DESC, sym) AS nth FROM hist)", "SELECT img, ch, CAST(nth AS INTEGER) AS nth, sym, cnt FROM t WHERE nth <= 5"))
def top_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A report of the five commonest residuals."""
    w = Window.partitionBy("img", "ch").orderBy(F.desc("cnt"), "sym")
    return med_histogram(spark, d).withColumn("nth", F.row_number().over(w)).filter("nth <= 5").select("img", "ch", "nth", "sym", "cnt")


@R.add(sql.q(*E_TP, "g AS (SELECT img, ch, v, coalesce(l, 0) AS l, coalesce(t, 0) AS t FROM tp WHERE i > 0 AND j > 0)", "SELECT img, ch, round(corr(v, l), 6) AS left_corr, round(corr(v, t), 6) AS top_corr, CAST(sum(abs(v - l)) AS BIGINT) AS dx, CAST(sum(abs(v - t)) AS BIGINT) AS dy FROM g GROUP BY ALL"))
def gradient_statistics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import neighbors

    df = neighbors.raw_taps(base.planes(spark, d), ("l", "t")).filter("i > 0 and j > 0")
    v, left, top = F.col("v"), F.col("l"), F.col("t")
    return df.groupBy("img", "ch").agg(F.round(F.corr(v, left), 6).alias("left_corr"), F.round(F.corr(v, top), 6).alias("top_corr"), F.sum(F.abs(v - left)).alias("dx"), F.sum(F.abs(v - top)).alias("dy"))


@R.add(sql.q(*E_H, sql.huffman("img, ch"), "SELECT img, CAST(sum(huff) AS BIGINT) AS payload, CAST(sum(24 * alphabet) AS BIGINT) AS tables, CAST(sum(16) AS BIGINT) AS headers, CAST(sum(huff + 16 + 24 * alphabet) + 64 AS BIGINT) AS total FROM hf GROUP BY img"))
def side_information_audit(spark: SparkSession, d: str) -> DataFrame:
    """Bits of a stream by section."""
    df = costs.huffman_bits(med_histogram(spark, d), ["img", "ch"])
    return df.groupBy("img").agg(F.sum("huff").alias("payload"), F.sum(24 * F.col("alphabet")).alias("tables"), F.sum(F.lit(16)).alias("headers"), (F.sum("stream") + 64).alias("total"))


@R.add(sql.q(*E_H, sql.huffman("img, ch"), sql.golomb("img, ch"), _BEST_K, "SELECT img, ch, least(huff + 16 + 24 * alphabet, gb.bits + 4) AS chosen, round(least(huff + 16 + 24 * alphabet, gb.bits + 4) - (SELECT sum(cnt) * log2(sum(cnt)) - sum(cnt * log2(cnt)) FROM hist WHERE hist.img = hf.img AND hist.ch = hf.ch), 4) AS gap FROM hf JOIN gb USING (img, ch)"))
def coding_autopsy(spark: SparkSession, d: str) -> DataFrame:
    """Chosen bits and their distance from the entropy."""
    hist, by = med_histogram(spark, d), ["img", "ch"]
    df = costs.huffman_bits(hist, by).join(costs.golomb_best(hist, by), by).join(costs.entropy_bits(hist, by, 9).select(*by, "entropy"), by)
    chosen = F.least("stream", F.col("bits") + 4)
    return df.select(*by, chosen.alias("chosen"), F.round(chosen - F.col("entropy"), 4).alias("gap"))


@R.add(sql.q(*E_TP, RES, "hist0 AS (SELECT img, ch, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL), hist AS (SELECT coalesce(CAST(img AS VARCHAR), 'all') AS img, coalesce(CAST(ch AS VARCHAR), 'all') AS ch, sym, CAST(sum(cnt) AS BIGINT) AS cnt FROM hist0 GROUP BY ROLLUP (img, ch), sym)", sql.huffman("img, ch"), "SELECT img, ch, n, alphabet, huff FROM hf"))
def huffman_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Shared tables by channel, by image and for all images, from one rollup of the histogram."""
    hist = med_histogram(spark, d)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    levels = hist.groupingSets([["img", "ch", "sym"], ["img", "sym"], ["sym"]], "img", "ch", "sym").agg(F.sum("cnt").alias("cnt"))
    return costs.huffman_bits(levels.select(name("img"), name("ch"), "sym", "cnt"), ["img", "ch"]).drop("stream")
