"""Queries that search: groups, experts, grids, splits and merges of least cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import contexts, costs, grouping, neighbors, predictors
from ..sources import rasters
from . import base, sql

R = base.Registry()
E_TP = (sql.EMB, sql.ycocg(), sql.taps())
BY = ["img", "ch"]


def key_cube(spark: SparkSession, d: str) -> DataFrame:
    """img, ch, key, sym, cnt: counts of sign-flipped residuals by gradient key. Any grouping of keys is a sum over it."""
    df = contexts.loco(base.taps(spark, d)).withColumn("r", F.col("sgn") * (F.col("v") - predictors.med(F.col("a"), F.col("b"), F.col("c"))))
    return costs.histogram(df, [*BY, "key"])


CUBE = f"cube AS (SELECT img, ch, key, sgn * (v - {sql.med()}) AS sym, count(*) AS cnt FROM lk GROUP BY ALL)"


def groups_sql(counts) -> str:
    return f"""qk AS (SELECT img, ch, key, sum(cnt) AS c, sum(abs(sym) * cnt) / CAST(sum(cnt) AS DOUBLE) AS mean FROM cube GROUP BY ALL),
qr AS (SELECT *, row_number() OVER (PARTITION BY img, ch ORDER BY mean, key) AS rn, sum(c) OVER (PARTITION BY img, ch) AS total FROM qk),
qg AS (SELECT img, ch, k, rn, key, total, 0 AS grp, CASE WHEN c * k >= total AND 0 < k - 1 THEN 0 ELSE c END AS acc, CASE WHEN c * k >= total AND 0 < k - 1 THEN 1 ELSE 0 END AS nxt FROM qr, (VALUES {', '.join(f'({k})' for k in counts)}) x(k) WHERE rn = 1
  UNION ALL SELECT g.img, g.ch, g.k, r.rn, r.key, r.total, g.nxt, CASE WHEN (g.acc + r.c) * g.k >= r.total AND g.nxt < g.k - 1 THEN 0 ELSE g.acc + r.c END, CASE WHEN (g.acc + r.c) * g.k >= r.total AND g.nxt < g.k - 1 THEN g.nxt + 1 ELSE g.nxt END FROM qg g JOIN qr r ON r.img = g.img AND r.ch = g.ch AND r.rn = g.rn + 1)"""


@R.add(sql.q(*E_TP, sql.LOCO, CUBE, groups_sql((6, 36)), "SELECT img, ch, k, key, grp FROM qg"))
def quantile_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.quantile_groups(key_cube(spark, d), BY, (6, 36))


_KS = grouping.GROUP_COUNTS


@R.add(sql.q(*E_TP, sql.LOCO, CUBE, groups_sql(_KS), "hist AS (SELECT img, ch, k, grp, sym, sum(cnt) AS cnt FROM cube JOIN qg USING (img, ch, key) GROUP BY ALL)", sql.huffman("img, ch, k, grp"), "act AS (SELECT img, ch, count(DISTINCT key) AS active FROM cube GROUP BY ALL)", sql.first("(SELECT hf.img, hf.ch, k, CAST(sum(huff + 16 + 24 * alphabet) + 12 + any_value(active) * CAST(ceil(log2(k)) AS INTEGER) AS BIGINT) AS bits FROM hf JOIN act USING (img, ch) GROUP BY hf.img, hf.ch, k)", "img, ch", "bits, k", "best"), "SELECT img, ch, k, bits FROM best"))
def auto_group_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of groups whose tables, data and map cost least."""
    cube = key_cube(spark, d)
    groups = grouping.quantile_groups(cube, BY, _KS)
    hist = cube.join(groups, [*BY, "key"]).groupBy(*BY, "k", "grp", "sym").agg(F.sum("cnt").alias("cnt"))
    each = costs.huffman_bits(hist, [*BY, "k", "grp"]).groupBy(*BY, "k").agg(F.sum("stream").alias("s"))
    active = cube.groupBy(*BY).agg(F.count_distinct("key").alias("active"))
    total = each.join(active, BY).withColumn("bits", F.col("s") + 12 + F.col("active") * grouping.bits_for(F.col("k")))
    return grouping.cheapest(total, BY, ("bits", "k")).select(*BY, "k", "bits")


_E9 = "least((abs(a - c) + abs(b - c)) >> 4, 8)"
#: Groups of keys for the choice of experts.
_GROUPS = 6


def expert_cube(spark: SparkSession, d: str, names) -> DataFrame:
    """img, ch, grp, ord, expert, sym, cnt: sign-flipped residuals of the named experts by quantile group of keys."""
    bank = predictors.bank()
    df = contexts.loco(base.taps(spark, d))
    ex = predictors.unpivoted(df, {n: bank[n] for n in names}, ["img", "ch", "key", "sgn", "v"]).withColumn("r", F.col("sgn") * (F.col("v") - F.col("p")))
    cube = costs.histogram(ex, [*BY, "key", "ord", "expert"])
    # the first expert's histogram is the cube of keys; a channel has some hundred keys
    groups = grouping.quantile_groups(cube.filter("ord = 0"), BY, (_GROUPS,)).drop("k")
    return cube.join(groups, [*BY, "key"]).groupBy(*BY, "grp", "ord", "expert", "sym").agg(F.sum("cnt").alias("cnt"))


def _chosen(names) -> tuple[str, ...]:
    grouped = "lg AS (SELECT lk.*, grp FROM lk JOIN qg ON qg.img = lk.img AND qg.ch = lk.ch AND qg.key = lk.key)"
    hist = "hist AS (SELECT img, ch, grp, ord, expert, sgn * (v - p) AS sym, count(*) AS cnt FROM ex GROUP BY ALL)"
    return (*E_TP, sql.LOCO, CUBE, groups_sql((_GROUPS,)), grouped, sql.experts(names, "lg", "img, ch, i, j, v, grp, sgn"), hist, sql.huffman("img, ch, grp, ord, expert"))


@R.add(sql.q(*_chosen(predictors.SMALL_BANK), sql.first("hf", "img, ch, grp", "huff, ord", "best"), "SELECT img, ch, grp, expert, huff FROM best"))
def best_expert_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Of the small bank the expert of least data bits in each quantile group."""
    bits = costs.huffman_bits(expert_cube(spark, d, predictors.SMALL_BANK), [*BY, "grp", "ord", "expert"])
    return grouping.cheapest(bits, [*BY, "grp"], ("huff", "ord", "expert")).drop("ord").select(*BY, "grp", "expert", "huff")


@R.add(sql.q(*_chosen(tuple(sql.BANK)), sql.golomb("img, ch, grp, ord, expert"), sql.first("gk", "img, ch, grp, ord, expert", "bits, k", "gb"), sql.first("(SELECT img, ch, grp, ord, expert, 0 AS b, huff + 16 + 24 * alphabet AS bits FROM hf UNION ALL SELECT img, ch, grp, ord, expert, 1, bits + 4 FROM gb)", "img, ch, grp", "bits, ord, b", "best"), "SELECT img, ch, grp, expert, CASE b WHEN 0 THEN 'H' ELSE 'G' END AS coder, bits FROM best"))
def best_expert_and_coder(spark: SparkSession, d: str) -> DataFrame:
    """Of the whole bank the expert, and of Huffman and Golomb codes the coder, of least bits in each quantile group."""
    cube = expert_cube(spark, d, tuple(predictors.bank()))
    by = [*BY, "grp", "ord", "expert"]
    both = F.array(F.struct(F.col("stream").alias("bits"), F.col("ord"), F.lit(0).alias("b"), F.col("expert")), F.struct((F.col("golomb") + 4).alias("bits"), F.col("ord"), F.lit(1).alias("b"), F.col("expert")))
    each = costs.three_costs(cube, by).select(*BY, "grp", F.array_min(both).alias("x")).select(*BY, "grp", "x.*")
    best = grouping.cheapest(each, [*BY, "grp"], ("bits", "ord", "b", "expert"))
    return best.select(*BY, "grp", "expert", F.when(F.col("b") == 0, "H").otherwise("G").alias("coder"), "bits")


_GRIDS = ", ".join(f"({k}, [{', '.join(map(str, g))}])" for k, g in enumerate(contexts.ENERGY_GRIDS))


@R.add(sql.q(*E_TP, f"gr(grid, th) AS (VALUES {_GRIDS}), rs AS (SELECT img, ch, abs(a - c) + abs(b - c) AS x, v - {sql.med()} AS r FROM b4), hist AS (SELECT img, ch, grid, len(list_filter(th, lambda t: t < x)) AS grp, r AS sym, count(*) AS cnt FROM rs, gr GROUP BY ALL)", sql.huffman("img, ch, grid, grp"), sql.first("(SELECT img, ch, grid, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits FROM hf GROUP BY ALL)", "img, ch", "bits, grid", "best"), "SELECT img, ch, grid, bits FROM best"))
def best_energy_grid(spark: SparkSession, d: str) -> DataFrame:
    df = base.med_residuals(spark, d).withColumn("x", F.abs(F.col("a") - F.col("c")) + F.abs(F.col("b") - F.col("c")))
    pairs = df.groupBy(*BY, "x", F.col("r").alias("sym")).agg(F.count(F.lit(1)).alias("cnt"))
    cells = [F.struct(F.lit(k).alias("grid"), contexts.level(F.col("x"), g).alias("grp")) for k, g in enumerate(contexts.ENERGY_GRIDS)]
    hist = pairs.select(*BY, "sym", "cnt", F.inline(F.array(*cells))).groupBy(*BY, "grid", "grp", "sym").agg(F.sum("cnt").alias("cnt"))
    each = costs.huffman_bits(hist, [*BY, "grid", "grp"]).groupBy(*BY, "grid").agg(F.sum("stream").alias("bits"))
    return grouping.cheapest(each, BY, ("bits", "grid")).select(*BY, "grid", "bits")


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), sql.experts(predictors.SMALL_BANK), sql.first("(SELECT img, ch, (i // 8) * 8 + j // 8 AS block, ord, expert, CAST(sum(abs(v - p)) AS BIGINT) AS l1 FROM ex GROUP BY ALL)", "img, ch, block", "l1, ord", "best"), "SELECT img, ch, block, expert, l1 FROM best"))
def block_experts(spark: SparkSession, d: str) -> DataFrame:
    """The expert of least error in every 8 x 8 block (the first of equals)."""
    bank = predictors.bank()
    df = predictors.unpivoted(base.taps(spark, d, "evt"), {n: bank[n] for n in predictors.SMALL_BANK}).withColumn("block", contexts.block(F.col("i"), F.col("j"), 8, 64))
    sums = df.groupBy(*BY, "block", "ord", "expert").agg(F.sum(F.abs(F.col("v") - F.col("p"))).alias("l1"))
    return grouping.cheapest(sums, [*BY, "block"], ("l1", "ord", "expert")).select(*BY, "block", "expert", "l1")


#: Candidate transforms of a block: permutation * 7 + type (fixed values).
CANDIDATES = (6, 27, 13, 12, 0, 20, 34, 3)


def _rct_sql() -> str:
    parts = []
    for o, code in enumerate(CANDIDATES):
        p, t = divmod(code, 7)
        a, m, c = ("rgb"[k] for k in color.PERMUTATIONS[p])
        tt = f"({c} + (({a} - {c}) >> 1))"
        x = f"({tt} + (({m} - {tt}) >> 1))" if t == 6 else a
        y = f"({a} - {c})" if t == 6 else f"({m} - {a})" if t in (2, 3) else f"({m} - (({a} + {c}) >> 1))" if t in (4, 5) else m
        z = f"({m} - {tt})" if t == 6 else f"({c} - {a})" if t in (1, 3, 5) else c
        parts += [f"SELECT img * 100 + {o} AS img, {k} AS ch, i, j, {v} AS v FROM evt" for k, v in enumerate((x, y, z))]
    return "pl AS (" + " UNION ALL ".join(parts) + ")"


@R.add(sql.q(sql.EVT, _rct_sql(), sql.taps(), f"s AS (SELECT img // 100 AS img, CAST(img % 100 AS INTEGER) AS o, (i // 16) * 4 + j // 16 AS block, CAST(sum(abs(v - {sql.med()})) AS BIGINT) AS l1 FROM b17 GROUP BY ALL)", sql.first("s", "img, block", "l1, o", "best"), "SELECT img, block, o, l1 FROM best"))
def block_transforms(spark: SparkSession, d: str) -> DataFrame:
    """The colour transform of least median-edge error in every 16 x 16 block."""
    rgb = rasters.event_raster(spark, d)
    zipped = F.arrays_zip("r", "g", "b")
    cells = []
    for o, code in enumerate(CANDIDATES):
        turn = color.rct(*divmod(code, 7))
        cells += [_plane(zipped, turn, o, k) for k in range(3)]
    planes = rgb.select("i", F.explode(F.array(*cells)).alias("x")).select("x.img", "x.ch", "i", "x.row")
    df = neighbors.corner_zero(neighbors.raw_taps(planes, ("l", "t", "tl")).withColumn("tr", F.lit(0)))
    r = F.abs(F.col("v") - predictors.med(F.col("left"), F.col("top"), F.col("topleft")))
    sums = df.groupBy(F.expr("img div 100").alias("img"), F.expr("cast(img % 100 as int)").alias("o"), contexts.block(F.col("i"), F.col("j"), 16, 64).alias("block")).agg(F.sum(r).alias("l1"))
    return grouping.cheapest(sums, ["img", "block"], ("l1", "o")).select("img", "block", "o", "l1")


def _plane(zipped, turn, o: int, k: int):
    return F.struct((F.col("img") * 100 + o).alias("img"), F.lit(k).alias("ch"), F.transform(zipped, lambda p: turn(p["r"], p["g"], p["b"])[k]).alias("row"))


_LUMA = f"lu AS (SELECT img, i, j, abs(v - {sql.med()}) AS ry FROM b4 WHERE ch = 0), cr AS (SELECT b4.img, ch, v - {sql.med()} AS r, (ry > 1)::INT AS y2 FROM b4 JOIN lu USING (img, i, j) WHERE ch > 0)"


@R.add(sql.q(*E_TP, _LUMA, "hist AS (SELECT img, ch, CAST(y2 AS INTEGER) AS part, r AS sym, count(*) AS cnt FROM cr GROUP BY ALL UNION ALL SELECT img, ch, -1, r, count(*) FROM cr GROUP BY ALL)", sql.huffman("img, ch, part"), "SELECT img, ch, CAST(sum(CASE WHEN part < 0 THEN huff + 16 + 24 * alphabet END) AS BIGINT) AS whole, CAST(sum(CASE WHEN part >= 0 THEN huff + 16 + 24 * alphabet END) AS BIGINT) AS split, sum(CASE WHEN part < 0 THEN huff + 16 + 24 * alphabet END) > sum(CASE WHEN part >= 0 THEN huff + 16 + 24 * alphabet END) AS kept FROM hf GROUP BY ALL"))
def gated_luma_split(spark: SparkSession, d: str) -> DataFrame:
    """A split by the luma residual is kept only if both parts, with their tables, cost less than the whole."""
    df = base.med_residuals(spark, d)
    px = df.groupBy("img", "i", "j").agg(F.max(F.when(F.col("ch") == 0, F.abs("r"))).alias("ry"), F.collect_list(F.struct("ch", "r")).alias("k")).select("img", "ry", F.inline("k")).filter("ch > 0")
    fine = px.groupBy(*BY, (F.col("ry") > 1).cast("int").alias("part"), F.col("r").alias("sym")).agg(F.count(F.lit(1)).alias("cnt"))
    both = fine.select(*BY, F.explode(F.array(F.col("part"), F.lit(-1))).alias("part"), "sym", "cnt").groupBy(*BY, "part", "sym").agg(F.sum("cnt").alias("cnt"))
    bits = costs.huffman_bits(both, [*BY, "part"])
    out = bits.groupBy(*BY).agg(F.sum(F.when(F.col("part") < 0, F.col("stream"))).alias("whole"), F.sum(F.when(F.col("part") >= 0, F.col("stream"))).alias("split"))
    return out.withColumn("kept", F.col("whole") > F.col("split"))


_EH = f"eh AS (SELECT img, ch, {_E9} AS e, v - {sql.med()} AS sym, count(*) AS cnt FROM b4 WHERE ch = 0 GROUP BY ALL)"


@R.add(sql.q(*E_TP, _EH, "es AS (SELECT DISTINCT img, ch, e FROM eh), pr AS (SELECT x.img, x.ch, x.e AS e1, y.e AS e2 FROM es x JOIN es y ON x.img = y.img AND x.ch = y.ch AND x.e < y.e), hist AS (SELECT img, ch, e AS e1, e AS e2, sym, cnt FROM eh UNION ALL SELECT pr.img, pr.ch, e1, e2, sym, sum(cnt) FROM pr JOIN eh ON eh.img = pr.img AND eh.ch = pr.ch AND (eh.e = e1 OR eh.e = e2) GROUP BY ALL)", sql.huffman("img, ch, e1, e2"), "one AS (SELECT img, ch, e1 AS e, huff + 16 + 24 * alphabet AS bits FROM hf WHERE e1 = e2)", sql.first("(SELECT h.img, h.ch, h.e1, h.e2, x.bits + y.bits - (h.huff + 16 + 24 * h.alphabet) AS gain FROM hf h JOIN one x ON x.img = h.img AND x.ch = h.ch AND x.e = h.e1 JOIN one y ON y.img = h.img AND y.ch = h.ch AND y.e = h.e2 WHERE h.e1 < h.e2)", "img, ch", "gain DESC, e1, e2", "best"), "SELECT img, ch, e1, e2, gain FROM best"))
def best_merge(spark: SparkSession, d: str) -> DataFrame:
    """The pair of energy classes whose union under one table saves most (one round of agglomeration)."""
    df = base.med_residuals(spark, d).filter("ch = 0").withColumn("e", contexts.energy9(F.col("a"), F.col("b"), F.col("c")))
    hist = costs.histogram(df, [*BY, "e"])
    # every class goes to the pairs it is in: nine classes, so at most 45 copies of a few rows
    pairs = hist.select(*BY, "e", "sym", "cnt", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("o")).select(*BY, F.least("e", "o").alias("e1"), F.greatest("e", "o").alias("e2"), "sym", "cnt")
    merged = pairs.groupBy(*BY, "e1", "e2", "sym").agg(F.sum("cnt").alias("cnt"))
    bits = costs.huffman_bits(merged, [*BY, "e1", "e2"])
    one = lambda n: bits.filter("e1 = e2").select(*BY, F.col("e1").alias(n), F.col("stream").alias(f"b_{n}"))
    gains = bits.filter("e1 < e2").join(one("e1"), [*BY, "e1"]).join(one("e2"), [*BY, "e2"]).withColumn("loss", F.col("stream") - F.col("b_e1") - F.col("b_e2"))
    best = grouping.cheapest(gains, BY, ("loss", "e1", "e2"))
    return best.select(*BY, "e1", "e2", (-F.col("loss")).alias("gain"))


@R.add(sql.q(*E_TP, _EH, "p AS (SELECT img, e, sym, cnt / CAST(sum(cnt) OVER (PARTITION BY img, e) AS DOUBLE) AS p FROM eh), es AS (SELECT DISTINCT img, e FROM p), pr AS (SELECT x.img, x.e AS e1, y.e AS e2 FROM es x JOIN es y ON x.img = y.img AND x.e < y.e), al AS (SELECT pr.img, e1, e2, sym, sum(CASE WHEN p.e = e1 THEN p ELSE 0 END) AS p1, sum(CASE WHEN p.e = e2 THEN p ELSE 0 END) AS p2 FROM pr JOIN p ON p.img = pr.img AND (p.e = e1 OR p.e = e2) GROUP BY ALL)", "SELECT img, e1, e2, round(sum(CASE WHEN p1 > 0 THEN p1 * log2(2 * p1 / (p1 + p2)) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * log2(2 * p2 / (p1 + p2)) ELSE 0 END) / 2, 6) AS js FROM al GROUP BY ALL"))
def histogram_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon divergence of every two energy classes of a luma plane."""
    df = base.med_residuals(spark, d).filter("ch = 0").withColumn("e", contexts.energy9(F.col("a"), F.col("b"), F.col("c")))
    hist = costs.histogram(df, ["img", "e"]).withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("img", "e")))
    there = hist.groupBy("img").agg(F.collect_set("e").alias("es"))
    pairs = hist.join(there, "img").select("img", "e", "sym", "p", F.explode("es").alias("o")).filter("e <> o")
    sides = pairs.groupBy("img", F.least("e", "o").alias("e1"), F.greatest("e", "o").alias("e2"), "sym").agg(F.sum(F.when(F.col("e") < F.col("o"), F.col("p")).otherwise(0)).alias("p1"), F.sum(F.when(F.col("e") > F.col("o"), F.col("p")).otherwise(0)).alias("p2"))
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(2 * F.col(x) / (F.col("p1") + F.col("p2")))).otherwise(0)
    return sides.groupBy("img", "e1", "e2").agg(F.round(F.sum(part("p1") + part("p2")) / 2, 6).alias("js"))


_CUTS = (2, 8, 24, 64)
_FEATS = ("abs(b - c)", "abs(a - c)", "abs(d - b)", "abs(a - b)")


@R.add(sql.q(*E_TP, "hist AS (" + " UNION ALL ".join(f"SELECT img, ch, {k} AS f, {t} AS cut, CAST(({x} > {t})::INT AS INTEGER) AS side, v - {sql.med()} AS sym, count(*) AS cnt FROM b4 WHERE ch = 0 GROUP BY ALL" for k, x in enumerate(_FEATS) for t in _CUTS) + ")", sql.huffman("img, ch, f, cut, side"), sql.first("(SELECT img, ch, f, cut, CAST(sum(huff + 16 + 24 * alphabet) + 27 AS BIGINT) AS bits FROM hf GROUP BY ALL)", "img, ch", "bits, f, cut", "best"), "SELECT img, ch, f, cut, bits FROM best"))
def best_tree_split(spark: SparkSession, d: str) -> DataFrame:
    """The feature and threshold that split a luma plane into two tables of least cost (27 bits for the split)."""
    df = base.med_residuals(spark, d).filter("ch = 0")
    feats = (F.abs(F.col("b") - F.col("c")), F.abs(F.col("a") - F.col("c")), F.abs(F.col("d") - F.col("b")), F.abs(F.col("a") - F.col("b")))
    cells = [F.struct(F.lit(k).alias("f"), x.alias("x")) for k, x in enumerate(feats)]
    hist = df.select(*BY, "r", F.inline(F.array(*cells))).groupBy(*BY, "f", "x", F.col("r").alias("sym")).agg(F.count(F.lit(1)).alias("cnt"))
    sides = hist.select(*BY, "f", "x", "sym", "cnt", F.explode(F.array(*[F.lit(t) for t in _CUTS])).alias("cut")).groupBy(*BY, "f", "cut", (F.col("x") > F.col("cut")).cast("int").alias("side"), "sym").agg(F.sum("cnt").alias("cnt"))
    bits = costs.huffman_bits(sides, [*BY, "f", "cut", "side"]).groupBy(*BY, "f", "cut").agg((F.sum("stream") + 27).alias("bits"))
    return grouping.cheapest(bits, BY, ("bits", "f", "cut")).select(*BY, "f", "cut", "bits")


@R.add(sql.q(*E_TP, sql.experts(), "s AS (SELECT expert, ord, CAST(sum(abs(v - p)) AS BIGINT) AS l1, max(abs(v - p)) AS worst FROM ex GROUP BY ALL)", "SELECT expert, l1, worst, NOT EXISTS (SELECT 1 FROM s o WHERE o.l1 <= s.l1 AND o.worst <= s.worst AND (o.l1 < s.l1 OR o.worst < s.worst)) AS efficient FROM s"))
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """Experts that no other beats in both mean and worst error."""
    s = base.expert_residuals(spark, d).groupBy("expert").agg(F.sum(F.abs("r")).alias("l1"), F.max(F.abs("r")).alias("worst"))
    # 16 rows against each other; sorted by one measure, a running minimum of the other decides
    o = s.select(F.col("l1").alias("l"), F.col("worst").alias("w"))
    beaten = s.join(o, (o["l"] <= s["l1"]) & (o["w"] <= s["worst"]) & ((o["l"] < s["l1"]) | (o["w"] < s["worst"])), "left_semi").select("expert").withColumn("beaten", F.lit(True))
    return s.join(beaten, "expert", "left").select("expert", "l1", "worst", F.col("beaten").isNull().alias("efficient"))


_BLOCKS = "bk AS (SELECT img, ch, i, j, v FROM pl WHERE ch = 0)"


_PATCHES = """st AS (SELECT DISTINCT img, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx FROM (SELECT DISTINCT img FROM bk), range(0, 57, 2) a(cy), range(0, 57, 2) b(cx)),
pa AS (SELECT st.img, cy, cx, list(v ORDER BY i, j) AS s FROM st JOIN bk ON bk.img = st.img AND i BETWEEN cy AND cy + 7 AND j BETWEEN cx AND cx + 7 GROUP BY st.img, cy, cx HAVING count(*) = 64),
s AS (SELECT t.img, t.cy AS y0, t.cx AS x0, o.cy, o.cx, CAST(list_sum(list_transform(list_zip(t.s, o.s), lambda z: abs(z[1] - z[2]))) AS BIGINT) AS sad
  FROM pa t JOIN pa o ON o.img = t.img AND (o.cy + 8 <= t.cy OR (o.cy >= t.cy - 7 AND o.cx + 8 <= t.cx)) WHERE t.cy % 8 = 0 AND t.cx % 8 = 0)"""


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), _BLOCKS, _PATCHES, sql.first("s", "img, y0, x0", "sad, cy, cx", "best"), "SELECT img, CAST(y0 AS BIGINT) AS block_i, CAST(x0 AS BIGINT) AS block_j, CAST(cy AS BIGINT) AS from_i, CAST(cx AS BIGINT) AS from_j, sad FROM best"))
def patch_search(spark: SparkSession, d: str) -> DataFrame:
    """The causal 8 x 8 patch at an even place nearest to each luma block, by the sum of absolute differences.

    A block meets the candidates of its own image only, as arrays of 64: an image has a fixed number of blocks."""
    planes = base.planes(spark, d, "evt").filter("ch = 0")
    band = F.collect_list("row").over(Window.partitionBy("img").orderBy("i").rowsBetween(0, 7))
    bands = planes.select("img", "i", band.alias("rows")).filter((F.size("rows") == 8) & (F.col("i") % 2 == 0) & (F.size(F.get("rows", F.lit(0))) >= 8))
    starts = F.sequence(F.lit(0), F.size(F.get("rows", F.lit(0))) - 8, F.lit(2))
    cells = F.transform(starts, lambda j: F.struct(j.alias("j"), F.flatten(F.transform("rows", lambda r: F.slice(r, j + 1, 8))).alias("s")))
    patches = bands.select("img", "i", F.inline(cells))
    blocks = patches.filter("i % 8 = 0 AND j % 8 = 0").select("img", F.col("i").cast("long").alias("block_i"), F.col("j").cast("long").alias("block_j"), "s")
    other = patches.select("img", F.col("i").cast("long").alias("from_i"), F.col("j").cast("long").alias("from_j"), F.col("s").alias("o"))
    earlier = (F.col("from_i") + 8 <= F.col("block_i")) | ((F.col("from_i") >= F.col("block_i") - 7) & (F.col("from_j") + 8 <= F.col("block_j")))
    pairs = blocks.join(other, "img").filter(earlier)
    sad = F.aggregate(F.zip_with("s", "o", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return grouping.cheapest(pairs.withColumn("sad", sad), ["img", "block_i", "block_j"], ("sad", "from_i", "from_j")).select("img", "block_i", "block_j", "from_i", "from_j", "sad")
