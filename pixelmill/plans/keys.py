"""Queries over context keys: which samples are coded together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import contexts, neighbors, predictors
from . import base, sql

R = base.Registry()
E_TP = (sql.EMB, sql.ycocg(), sql.taps())
_E9 = "least((abs(a - c) + abs(b - c)) >> 4, 8)"
_RES = f"rs AS (SELECT *, v - {sql.med()} AS r FROM b4)"


@R.add(sql.q(*E_TP, _RES, f"SELECT img, ch, {_E9} AS e, count(*) AS n, CAST(sum(abs(r)) AS BIGINT) AS l1 FROM rs GROUP BY ALL"))
def context_energy9(spark: SparkSession, d: str) -> DataFrame:
    return base.med_residuals(spark, d).groupBy("img", "ch", contexts.energy9(F.col("a"), F.col("b"), F.col("c")).alias("e")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("r")).alias("l1"))


_GRIDS = ", ".join(f"({k}, [{', '.join(map(str, g))}])" for k, g in enumerate(contexts.ENERGY_GRIDS))


@R.add(sql.q(*E_TP, f"gr(grid, th) AS (VALUES {_GRIDS})", "SELECT img, ch, grid, CAST(len(list_filter(th, lambda x: x < abs(a - c) + abs(b - c))) AS INTEGER) AS grp, count(*) AS n FROM b4, gr GROUP BY ALL"))
def context_energy_grids(spark: SparkSession, d: str) -> DataFrame:
    """Energy groups under each of the fixed grids; a histogram of the energy comes first, so grids cost nothing per sample."""
    e = (F.abs(F.col("a") - F.col("c")) + F.abs(F.col("b") - F.col("c"))).alias("e")
    hist = base.taps(spark, d).groupBy("img", "ch", e).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(F.lit(k).alias("grid"), contexts.level(F.col("e"), g).alias("grp")) for k, g in enumerate(contexts.ENERGY_GRIDS)]
    return hist.select("img", "ch", "n", F.inline(F.array(*cells))).groupBy("img", "ch", "grid", "grp").agg(F.sum("n").alias("n"))


@R.add(sql.q(*E_TP, sql.LOCO, "SELECT img, ch, key, sgn, count(*) AS n FROM lk GROUP BY ALL"))
def context_loco(spark: SparkSession, d: str) -> DataFrame:
    return contexts.loco(base.taps(spark, d)).groupBy("img", "ch", "key", "sgn").agg(F.count(F.lit(1)).alias("n"))


@R.add(sql.q(*E_TP, "q AS (SELECT " + sql.LEVEL.format(g="(b - c)") + " AS q FROM b4)", "SELECT q, count(*) AS n FROM q GROUP BY q"))
def gradient_levels(spark: SparkSession, d: str) -> DataFrame:
    return base.taps(spark, d).groupBy(contexts.gradient_level(F.col("b") - F.col("c")).alias("q")).agg(F.count(F.lit(1)).alias("n"))


@R.add(sql.q(*E_TP, sql.LOCO, f"SELECT img, ch, key, CAST(sum(sgn * (v - {sql.med()})) AS BIGINT) AS s, CAST(sum(abs(v - {sql.med()})) AS BIGINT) AS l1 FROM lk GROUP BY ALL"))
def sign_flipped_residuals(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("sgn") * (F.col("v") - predictors.med(F.col("a"), F.col("b"), F.col("c")))
    return contexts.loco(base.taps(spark, d)).groupBy("img", "ch", "key").agg(F.sum(r).alias("s"), F.sum(F.abs(r)).alias("l1"))


@R.add(sql.q(*E_TP, "SELECT img, ch, (x >= 4)::INT + (x >= 12)::INT + (x >= 48)::INT AS act, count(*) AS n FROM (SELECT img, ch, abs(a - c) + abs(b - c) AS x FROM b17) GROUP BY ALL"))
def context_activity(spark: SparkSession, d: str) -> DataFrame:
    df = neighbors.corner_zero(neighbors.raw_taps(base.planes(spark, d), ("l", "t", "tl", "tr")))
    return df.groupBy("img", "ch", contexts.activity(df).alias("act")).agg(F.count(F.lit(1)).alias("n"))


_ZE = "(abs(coalesce(l, 0) - coalesce(t, 0)) + abs(coalesce(l, 0) - coalesce(tl, 0)) + abs(coalesce(t, 0) - coalesce(tl, 0)))"


@R.add(sql.q(*E_TP, f"z AS (SELECT img, ch, {_ZE} AS e FROM tp), th AS (SELECT img, ch, quantile_cont(CAST(e AS DOUBLE), [{', '.join(f'{k}/9.0' for k in range(1, 9))}]) AS t FROM z GROUP BY ALL)", "SELECT z.img, z.ch, CAST(len(list_filter(t, lambda x: x < e)) AS INTEGER) AS ctx, count(*) AS n, CAST(sum(e) AS BIGINT) AS energy FROM z JOIN th USING (img, ch) GROUP BY ALL"))
def context_quantile_energy(spark: SparkSession, d: str) -> DataFrame:
    """Nine bins of an energy by its own quantiles (linear interpolation) in each image and channel."""
    df = neighbors.all_zero(neighbors.raw_taps(base.planes(spark, d), ("l", "t", "tl")))
    e = F.abs(F.col("l") - F.col("t")) + F.abs(F.col("l") - F.col("tl")) + F.abs(F.col("t") - F.col("tl"))
    hist = df.groupBy("img", "ch", e.alias("e")).agg(F.count(F.lit(1)).alias("cnt"))  # quantiles of counts: few rows
    cuts = hist.groupBy("img", "ch").agg(F.percentile("e", F.array(*[F.lit(k / 9) for k in range(1, 9)]), F.col("cnt")).alias("t"))
    return hist.join(cuts, ["img", "ch"]).groupBy("img", "ch", F.size(F.filter("t", lambda x: x < F.col("e"))).alias("ctx")).agg(F.sum("cnt").alias("n"), F.sum(F.col("e") * F.col("cnt")).alias("energy"))


_ERR = f"""er AS (SELECT lk.*, v - {sql.med()} AS r FROM lk), e1 AS (SELECT *, coalesce(lag(abs(r)) OVER (PARTITION BY img, ch, i ORDER BY j), 0) AS rl, coalesce(lag(abs(r)) OVER (PARTITION BY img, ch, j ORDER BY i), 0) AS rt FROM er)"""


@R.add(sql.q(*E_TP, sql.LOCO, _ERR, "SELECT img, ch, CAST(key * 4 + least(rl // 3, 3) AS BIGINT) AS err4, CAST(key * 4 + least(rt // 3, 3) AS BIGINT) AS err4t, count(*) AS n FROM e1 GROUP BY ALL"))
def context_error_keys(spark: SparkSession, d: str) -> DataFrame:
    """Gradient keys refined by the size of the residual to the left, and above."""
    df = contexts.loco(base.taps(spark, d)).withColumn("r", F.abs(F.col("v") - predictors.med(F.col("a"), F.col("b"), F.col("c"))))
    rows = df.groupBy("img", "ch", "i").agg(F.array_sort(F.collect_list(F.struct("j", "r", "key"))).alias("p"))
    rows = rows.withColumn("up", F.lag("p.r").over(Window.partitionBy("img", "ch").orderBy("i")))
    third = lambda x: F.least(F.floor(F.coalesce(x, F.lit(0)) / 3), F.lit(3))
    cell = lambda x, j: F.struct((x["key"] * 4 + third(F.get("p.r", j - 1))).alias("err4"), (x["key"] * 4 + third(F.get("up", j))).alias("err4t"))
    return rows.select("img", "ch", F.inline(F.transform("p", cell))).groupBy("img", "ch", "err4", "err4t").agg(F.count(F.lit(1)).alias("n"))


@R.add(sql.q(*E_TP, sql.LOCO, f"lu AS (SELECT img, i, j, abs(v - {sql.med()}) AS ry FROM b4 WHERE ch = 0)", "SELECT img, ch, CAST(CASE WHEN ch = 0 THEN key ELSE key * 4 + least(ry // 4, 3) END AS BIGINT) AS ymag, count(*) AS n FROM lk JOIN lu USING (img, i, j) GROUP BY ALL"))
def context_luma_magnitude(spark: SparkSession, d: str) -> DataFrame:
    """Chroma keys refined by the luma residual at the same place."""
    df = contexts.loco(base.taps(spark, d)).withColumn("r", F.abs(F.col("v") - predictors.med(F.col("a"), F.col("b"), F.col("c"))))
    px = df.groupBy("img", "i", "j").agg(F.max(F.when(F.col("ch") == 0, F.col("r"))).alias("ry"), F.collect_list(F.struct("ch", "key")).alias("k"))
    px = px.select("img", "ry", F.inline("k"))
    key = F.when(F.col("ch") == 0, F.col("key")).otherwise(F.col("key") * 4 + F.least(F.floor(F.col("ry") / 4), F.lit(3)))
    return px.groupBy("img", "ch", key.alias("ymag")).agg(F.count(F.lit(1)).alias("n"))


@R.add(sql.q(*E_TP, sql.LOCO, "SELECT img, ch, least(abs(q1) + abs(q2) + abs(q3), 8) AS tier, count(*) AS n FROM lk GROUP BY ALL"))
def context_tiers(spark: SparkSession, d: str) -> DataFrame:
    q = contexts.loco(base.taps(spark, d))
    return q.groupBy("img", "ch", contexts.tier(*map(F.col, ("q1", "q2", "q3"))).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def _with_luma(spark: SparkSession, d: str) -> DataFrame:
    df = base.med_residuals(spark, d)
    px = df.groupBy("img", "i", "j").agg(F.max(F.when(F.col("ch") == 0, F.abs("r"))).alias("ry"), F.collect_list(F.struct("ch", "r")).alias("k"))
    return px.select("img", "i", "j", "ry", F.inline("k")).filter("ch > 0")


_LUMA = f"lu AS (SELECT img, i, j, abs(v - {sql.med()}) AS ry FROM b4 WHERE ch = 0), cr AS (SELECT b4.img, ch, b4.i, b4.j, v - {sql.med()} AS r, ry FROM b4 JOIN lu USING (img, i, j) WHERE ch > 0)"
#: Bounds of |luma residual| by number of bins (fixed values).
LUMA_BOUNDS = {2: (1,), 3: (1, 4), 4: (0, 2, 7)}


@R.add(sql.q(*E_TP, _LUMA, "SELECT k, img, ch, CASE k " + " ".join(f"WHEN {k} THEN " + " + ".join(f"(ry > {t})::INT" for t in b) for k, b in LUMA_BOUNDS.items()) + " END AS bin, count(*) AS n, CAST(sum(abs(r)) AS BIGINT) AS l1 FROM cr, (VALUES (2), (3), (4)) x(k) GROUP BY ALL"))
def context_luma_bins(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.struct(F.lit(k).alias("k"), contexts.level(F.col("ry"), b).alias("bin")) for k, b in LUMA_BOUNDS.items()]
    df = _with_luma(spark, d).select("img", "ch", "r", F.inline(F.array(*cells)))
    return df.groupBy("k", "img", "ch", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("r")).alias("l1"))


@R.add(sql.q(*E_TP, _LUMA, "th AS (SELECT img, ch, quantile_cont(CAST(ry AS DOUBLE), [0.25, 0.5, 0.75]) AS t FROM cr GROUP BY ALL)", "SELECT cr.img, cr.ch, CAST(len(list_filter(t, lambda x: x < ry)) AS INTEGER) AS bin, count(*) AS n, CAST(sum(abs(r)) AS BIGINT) AS l1 FROM cr JOIN th USING (img, ch) GROUP BY ALL"))
def context_luma_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    hist = _with_luma(spark, d).groupBy("img", "ch", "ry").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("r")).alias("l1"))
    cuts = hist.groupBy("img", "ch").agg(F.percentile("ry", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("t"))
    return hist.join(cuts, ["img", "ch"]).groupBy("img", "ch", F.size(F.filter("t", lambda x: x < F.col("ry"))).alias("bin")).agg(F.sum("n").alias("n"), F.sum("l1").alias("l1"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), "SELECT n AS parts, img, ch, ((i * n) // 64) * n + (j * n) // 64 AS cell, count(*) AS cnt, CAST(sum(v) AS BIGINT) AS total FROM pl, (VALUES (2), (4)) x(n) GROUP BY ALL"))
def spatial_cells(spark: SparkSession, d: str) -> DataFrame:
    df = base.planes(spark, d, "evt").select("img", "ch", "i", F.posexplode("row").alias("j", "v"))
    cells = [F.struct(F.lit(n).alias("parts"), contexts.cell(F.col("i"), F.col("j"), 64, 64, n).alias("cell")) for n in (2, 4)]
    return df.select("img", "ch", "v", F.inline(F.array(*cells))).groupBy("parts", "img", "ch", "cell").agg(F.count(F.lit(1)).alias("cnt"), F.sum("v").alias("total"))


@R.add(sql.q(*E_TP, _RES, "SELECT n AS bands, img, ch, CAST((i * n) // 64 AS BIGINT) AS band, count(*) AS cnt, CAST(sum(abs(r)) AS BIGINT) AS l1 FROM rs, (VALUES (2), (4)) x(n) GROUP BY ALL"))
def horizontal_bands(spark: SparkSession, d: str) -> DataFrame:
    df = base.med_residuals(spark, d).groupBy("img", "ch", "i").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.abs("r")).alias("l1"))
    cells = [F.struct(F.lit(n).alias("bands"), F.floor(F.col("i") * n / 64).alias("band")) for n in (2, 4)]
    return df.select("img", "ch", "cnt", "l1", F.inline(F.array(*cells))).groupBy("bands", "img", "ch", "band").agg(F.sum("cnt").alias("cnt"), F.sum("l1").alias("l1"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), "SELECT s AS size, img, ch, (i // s) * (64 // s) + j // s AS block, min(v) AS lo, max(v) AS hi, CAST(sum(v) AS BIGINT) AS total FROM pl, (VALUES (8), (16), (32), (64)) x(s) GROUP BY ALL"))
def block_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = base.planes(spark, d, "evt").select("img", "ch", "i", F.posexplode("row").alias("j", "v"))
    cells = [F.struct(F.lit(s).alias("size"), contexts.block(F.col("i"), F.col("j"), s, 64).alias("block")) for s in (8, 16, 32, 64)]
    return df.select("img", "ch", "v", F.inline(F.array(*cells))).groupBy("size", "img", "ch", "block").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("total"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), "SELECT img, ch, CAST(sum((a = b AND b = c AND c = d AND NOT (i = 0 AND j = 0))::INT) AS BIGINT) AS flat, count(*) AS n FROM b4 GROUP BY ALL"))
def flat_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    flat = contexts.flat(F.col("a"), F.col("b"), F.col("c"), F.col("d")) & ~((F.col("i") == 0) & (F.col("j") == 0))
    return base.taps(spark, d, "evt").groupBy("img", "ch").agg(F.sum(flat.cast("int")).alias("flat"), F.count(F.lit(1)).alias("n"))


@R.add(sql.q(*E_TP, f"SELECT img, ch, CAST(sum(abs(b - c)) AS BIGINT) AS f0, CAST(sum(abs(a - c)) AS BIGINT) AS f1, CAST(sum(abs(d - b)) AS BIGINT) AS f2, CAST(sum(abs(b - c) + abs(a - c)) AS BIGINT) AS f3, CAST(sum({_E9}) AS BIGINT) AS f4, CAST(sum(abs(a - b)) AS BIGINT) AS f5, CAST(sum(abs(a + b - 2 * c) >> 1) AS BIGINT) AS f6, CAST(sum((a + b) >> 1) AS BIGINT) AS f7, max(i) AS f8, max(j) AS f9 FROM b4 GROUP BY ALL"))
def tree_features(spark: SparkSession, d: str) -> DataFrame:
    feats = (F.abs(F.col("b") - F.col("c")), F.abs(F.col("a") - F.col("c")), F.abs(F.col("d") - F.col("b")), F.abs(F.col("b") - F.col("c")) + F.abs(F.col("a") - F.col("c")), contexts.energy9(F.col("a"), F.col("b"), F.col("c")), F.abs(F.col("a") - F.col("b")), color.half(F.abs(F.col("a") + F.col("b") - 2 * F.col("c"))), color.half(F.col("a") + F.col("b")))
    return base.taps(spark, d).groupBy("img", "ch").agg(*[F.sum(x).alias(f"f{k}") for k, x in enumerate(feats)], F.max("i").alias("f8"), F.max("j").alias("f9"))


@R.add(sql.q(*E_TP, _RES, "SELECT img, ch, min(r) AS lo, max(r) AS hi, CAST(sum((abs(r) > 1024)::INT) AS BIGINT) AS violations FROM rs GROUP BY ALL"))
def alphabet_guard(spark: SparkSession, d: str) -> DataFrame:
    """Residuals must lie within -1024..1024; violations are counted, never clipped."""
    return base.med_residuals(spark, d).groupBy("img", "ch").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum((F.abs("r") > 1024).cast("int")).alias("violations"))


@R.add(sql.q(*E_TP, _RES, "SELECT img, ch, least(3, abs(a - c) >> 4) * 4 + least(3, abs(b - c) >> 4) AS ctx, count(*) AS n, CAST(sum(r) AS BIGINT) AS s, CAST(round_even(sum(r) / CAST(count(*) AS DOUBLE), 0) AS INTEGER) AS bias FROM rs GROUP BY ALL"))
def context_bias_table(spark: SparkSession, d: str) -> DataFrame:
    ctx = F.least(F.lit(3), F.shiftright(F.abs(F.col("a") - F.col("c")), 4)) * 4 + F.least(F.lit(3), F.shiftright(F.abs(F.col("b") - F.col("c")), 4))
    return base.med_residuals(spark, d).groupBy("img", "ch", ctx.alias("ctx")).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"), F.rint(F.sum("r") / F.count(F.lit(1))).cast("int").alias("bias"))


#: Chroma splits by the luma residual (fixed bounds): more than 1; and 0, 2, 7.
@R.add(sql.q(*E_TP, _LUMA, "SELECT img, ch, (ry > 1)::INT AS y2, (ry > 0)::INT + (ry > 2)::INT + (ry > 7)::INT AS y4, count(*) AS n, CAST(sum(r) AS BIGINT) AS s FROM cr GROUP BY ALL"))
def context_chroma_splits(spark: SparkSession, d: str) -> DataFrame:
    ry = F.col("ry")
    return _with_luma(spark, d).groupBy("img", "ch", contexts.level(ry, (1,)).alias("y2"), contexts.level(ry, (0, 2, 7)).alias("y4")).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"))
