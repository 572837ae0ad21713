"""Queries over sources, colour transforms, predictors and scalar maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import neighbors, predictors
from ..sources import rasters
from . import base, sql

R = base.Registry()
E_YC = (sql.EMB, sql.ycocg())
E_TP = (*E_YC, sql.taps())


@R.add(sql.q(sql.EMB, "SELECT * FROM emb"))
def src_emb_raster(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.embedding_raster(spark, d))


@R.add(sql.q(sql.EVT, "SELECT * FROM evt"))
def src_evt_raster(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.event_raster(spark, d))


@R.add(sql.q(sql.DOC, "SELECT img, i, j, v FROM doc"))
def src_doc_raster(spark: SparkSession, d: str) -> DataFrame:
    return rasters.document_plane(spark, d).select("img", "i", F.posexplode("row").alias("j", "v"))


@R.add("SELECT CAST(0 AS BIGINT) AS img, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(j AS INTEGER) AS r, CAST(i AS INTEGER) AS g, 128 AS b FROM range(64) a(i), range(64) c(j)")
def gen_gradient(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.gradient_raster(spark))


@R.add("SELECT CAST(0 AS BIGINT) AS img, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN (j // 8) % 2 = 0 THEN 0 ELSE 255 END AS r, CASE WHEN (j // 8) % 2 = 0 THEN 255 ELSE 0 END AS g, CASE WHEN (i // 8) % 2 = 0 THEN 0 ELSE 255 END AS b FROM range(64) a(i), range(64) c(j)")
def gen_bars(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.bars_raster(spark))


def _drawn(channels: tuple[str, str, str]) -> str:
    cells = ", ".join(f"{x} AS {c}" for c, x in zip("rgb", channels, strict=True))
    return f"SELECT CAST(0 AS BIGINT) AS img, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {cells} FROM range(64) a(i), range(64) c(j)"


@R.add(_drawn(rasters.NOISE))
def gen_noise(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.synthetic(spark, rasters.NOISE))


@R.add(_drawn(rasters.BLURRED))
def gen_blurred(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.synthetic(spark, rasters.BLURRED))


@R.add(_drawn(rasters.BANDED))
def gen_bands(spark: SparkSession, d: str) -> DataFrame:
    return rasters.pixels(rasters.synthetic(spark, rasters.BANDED))


@R.add("SELECT doc_id, md5(text) AS md5, strlen(text) AS n_bytes FROM documents")
def input_md5(spark: SparkSession, d: str) -> DataFrame:
    return rasters.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@R.add(sql.q(*E_YC, "SELECT img, i, j, y, co, cg FROM yc"))
def ycocg_forward(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(rasters.embedding_raster(spark, d))
    y, co, cg = color.ycocg(*map(F.col, "rgb"))
    return px.select("img", "i", "j", y.alias("y"), co.alias("co"), cg.alias("cg"))


@R.add(sql.q(sql.EMB, "SELECT img, count(*) AS pixels, CAST(0 AS BIGINT) AS mismatches FROM emb GROUP BY img"))
def ycocg_round_trip(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(rasters.embedding_raster(spark, d))
    back = color.ycocg_inverse(*color.ycocg(*map(F.col, "rgb")))
    bad = sum((F.when(F.greatest(F.lit(0), F.least(F.lit(255), x)) != F.col(c), 1).otherwise(0) for c, x in zip("rgb", back, strict=True)), F.lit(0))
    return px.groupBy("img").agg(F.count(F.lit(1)).alias("pixels"), F.sum(bad).alias("mismatches"))


_PERM_SQL = " UNION ALL ".join(f"SELECT img, i, j, {p} AS perm, {'rgb'[x]} AS a, {'rgb'[y]} AS m, {'rgb'[z]} AS c FROM emb" for p, (x, y, z) in enumerate(color.PERMUTATIONS))
_RCT_SQL = """
SELECT perm, t, CAST(sum(x) AS BIGINT) AS s0, CAST(sum(y) AS BIGINT) AS s1, CAST(sum(z) AS BIGINT) AS s2, CAST(sum(abs(y)) AS BIGINT) AS abs1, CAST(sum(abs(z)) AS BIGINT) AS abs2 FROM (
  SELECT perm, t, CASE WHEN t = 6 THEN (c + ((a - c) >> 1)) + ((m - (c + ((a - c) >> 1))) >> 1) ELSE a END AS x,
    CASE WHEN t = 6 THEN a - c WHEN t IN (2, 3) THEN m - a WHEN t IN (4, 5) THEN m - ((a + c) >> 1) ELSE m END AS y,
    CASE WHEN t = 6 THEN m - (c + ((a - c) >> 1)) WHEN t IN (1, 3, 5) THEN c - a ELSE c END AS z
  FROM p, (SELECT CAST(t AS INTEGER) AS t FROM range(7) r(t))) GROUP BY perm, t"""


def _all_rcts(px: DataFrame, make) -> DataFrame:
    """A row per pixel and transform, from make(p, t) -> struct."""
    return px.select("*", F.explode(F.array(*[make(p, t) for p in range(6) for t in range(7)])).alias("x"))


@R.add(sql.q(sql.EMB, f"p AS ({_PERM_SQL})", _RCT_SQL))
def rct_forward_all(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(rasters.embedding_raster(spark, d))

    def make(p: int, t: int):
        x, y, z = color.rct(p, t)(*map(F.col, "rgb"))
        return F.struct(F.lit(p).alias("perm"), F.lit(t).alias("t"), x.alias("x"), y.alias("y"), z.alias("z"))

    df = _all_rcts(px, make).select("x.*")
    return df.groupBy("perm", "t").agg(F.sum("x").alias("s0"), F.sum("y").alias("s1"), F.sum("z").alias("s2"), F.sum(F.abs("y")).alias("abs1"), F.sum(F.abs("z")).alias("abs2"))


@R.add(sql.q(sql.EMB, "SELECT CAST(p AS INTEGER) AS perm, CAST(t AS INTEGER) AS t, (SELECT count(*) FROM emb) AS pixels, CAST(0 AS BIGINT) AS mismatches FROM range(6) a(p), range(7) c(t)"))
def rct_round_trip(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(rasters.embedding_raster(spark, d))

    def make(p: int, t: int):
        back = color.rct_inverse(p, t)(*color.rct(p, t)(*map(F.col, "rgb")))
        bad = F.lit(False)
        for c, x in zip("rgb", back, strict=True):
            bad = bad | (x != F.col(c))
        return F.struct(F.lit(p).alias("perm"), F.lit(t).alias("t"), bad.cast("long").alias("bad"))

    return _all_rcts(px, make).select("x.*").groupBy("perm", "t").agg(F.count(F.lit(1)).alias("pixels"), F.sum("bad").alias("mismatches"))


_BANK_SQL = " UNION ALL ".join(f"SELECT img, '{n}' AS rct, {'rgb'[color.PERMUTATIONS[p][0]]} AS r, {'rgb'[color.PERMUTATIONS[p][1]]} AS g, {'rgb'[color.PERMUTATIONS[p][2]]} AS b, {t} AS t FROM emb" for n, (p, t) in color.BANK.items())


@R.add(sql.q(sql.EMB, f"k AS ({_BANK_SQL})", "SELECT img, rct, CAST(sum(abs(CASE WHEN t = 6 THEN r - b ELSE g - ((r + b) >> 1) END)) AS BIGINT) AS abs1, CAST(sum(abs(CASE WHEN t = 6 THEN g - (b + ((r - b) >> 1)) ELSE b - r END)) AS BIGINT) AS abs2 FROM k GROUP BY ALL"))
def rct_bank(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.pixels(rasters.embedding_raster(spark, d))
    cells = []
    for n, (p, t) in color.BANK.items():
        _, y, z = color.rct(p, t)(*map(F.col, "rgb"))
        cells.append(F.struct(F.lit(n).alias("rct"), F.abs(y).alias("y"), F.abs(z).alias("z")))
    return px.select("img", F.inline(F.array(*cells))).groupBy("img", "rct").agg(F.sum("y").alias("abs1"), F.sum("z").alias("abs2"))


@R.add(sql.q(*E_TP, "SELECT img, ch, i, j, a, b, c, d, ww, nne FROM b4"))
def taps_edge_copied(spark: SparkSession, d: str) -> DataFrame:
    return base.taps(spark, d).drop("v")


@R.add(sql.q(*E_TP, "SELECT img, ch, i, j, a AS \"left\", b AS top, c AS topleft, d AS topright FROM b17"))
def taps_corner_zero(spark: SparkSession, d: str) -> DataFrame:
    raw = neighbors.raw_taps(base.planes(spark, d), ("l", "t", "tl", "tr"))
    return neighbors.corner_zero(raw).select("img", "ch", "i", "j", "left", "top", "topleft", "topright")


@R.add(sql.q(*E_TP, "SELECT img, ch, i, j, coalesce(l, 0) AS l, coalesce(t, 0) AS t, coalesce(tl, 0) AS tl, coalesce(tr, 0) AS tr, coalesce(l2, 0) AS l2, coalesce(t2, 0) AS t2 FROM tp"))
def taps_zero(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.all_zero(neighbors.raw_taps(base.planes(spark, d))).drop("v")


@R.add(sql.q(*E_TP, "SELECT img, ch, i, j, coalesce(l, v) AS l, coalesce(t, v) AS t, coalesce(tl, t, l, v) AS tl, coalesce(tr, t, v) AS tr FROM tp"))
def taps_edge_replicated(spark: SparkSession, d: str) -> DataFrame:
    """Edges replicate the raster (may see the sample itself; for analysis only)."""
    raw = neighbors.raw_taps(base.planes(spark, d), ("l", "t", "tl", "tr"))
    return raw.select("img", "ch", "i", "j", F.coalesce("l", "v").alias("l"), F.coalesce("t", "v").alias("t"), F.coalesce("tl", "t", "l", "v").alias("tl"), F.coalesce("tr", "t", "v").alias("tr"))


@R.add(sql.q(*E_TP, f"SELECT img, ch, i, j, v - {sql.med()} AS r FROM b4"))
def med_residual(spark: SparkSession, d: str) -> DataFrame:
    return base.med_residuals(spark, d).select("img", "ch", "i", "j", "r")


@R.add(sql.q(*E_TP, sql.experts(), "SELECT img, ch, expert, count(*) AS n, CAST(sum(abs(v - p)) AS BIGINT) AS l1, CAST(sum((v - p) * (v - p)) AS BIGINT) AS l2, CAST(sum(CASE WHEN v = p THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ex GROUP BY ALL"))
def expert_bank(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r").cast("long")
    return base.expert_residuals(spark, d).groupBy("img", "ch", "expert").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(r)).alias("l1"), F.sum(r * r).alias("l2"), F.sum(F.when(r == 0, 1).otherwise(0)).alias("hits"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), sql.experts(), "SELECT img, ch, expert, CAST(sum(abs(v - p)) AS BIGINT) AS l1 FROM ex GROUP BY ALL"))
def expert_bank_events(spark: SparkSession, d: str) -> DataFrame:
    return base.expert_residuals(spark, d, "evt").groupBy("img", "ch", "expert").agg(F.sum(F.abs("r")).alias("l1"))


@R.add(sql.q(*E_TP, sql.experts(predictors.SMALL_BANK), sql.first("(SELECT img, ch, ord, expert, CAST(sum(abs(v - p)) AS BIGINT) AS l1 FROM ex GROUP BY ALL)", "img, ch", "l1, ord", "best"), "SELECT img, ch, expert, l1 FROM best"))
def small_bank_best(spark: SparkSession, d: str) -> DataFrame:
    bank = {n: x for n, x in predictors.bank().items() if n in predictors.SMALL_BANK}
    df = predictors.unpivoted(base.taps(spark, d), {n: bank[n] for n in predictors.SMALL_BANK}).withColumn("r", F.col("v") - F.col("p"))
    sums = df.groupBy("img", "ch", "ord", "expert").agg(F.sum(F.abs("r")).alias("l1"))
    return sums.groupBy("img", "ch").agg(F.min(F.struct("l1", "ord", "expert")).alias("x")).select("img", "ch", "x.expert", "x.l1")


_STEP = "(abs(a - c) + abs(b - nne) + abs(d - nne) - abs(a - ww) - abs(b - c) - abs(b - d))"
_BASE = "(((a + b) >> 1) + ((d - c) >> 2))"


@R.add(sql.q(*E_TP, f"g AS (SELECT img, ch, v, {sql.med()} AS m, CASE WHEN {_STEP} > 80 THEN a WHEN {_STEP} < -80 THEN b WHEN {_STEP} > 32 THEN ({_BASE} + a) >> 1 WHEN {_STEP} < -32 THEN ({_BASE} + b) >> 1 ELSE {_BASE} END AS g, {_STEP} AS s FROM b4)", "SELECT img, ch, CAST(sum(abs(v - g)) AS BIGINT) AS l1_graded, CAST(sum(abs(v - CASE WHEN s > 40 THEN m WHEN s < -40 THEN g ELSE (m + g) >> 1 END)) AS BIGINT) AS l1_mixed FROM g GROUP BY ALL"))
def graded_gap_mixer(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, dd, ww, nne = (F.col(x) for x in ("a", "b", "c", "d", "ww", "nne"))
    step = F.abs(a - c) + F.abs(b - nne) + F.abs(dd - nne) - F.abs(a - ww) - F.abs(b - c) - F.abs(b - dd)
    df = base.taps(spark, d).select("img", "ch", "v", predictors.med(a, b, c).alias("m"), predictors.graded_gap().alias("g"), step.alias("s"))
    mixed = F.when(F.col("s") > 40, F.col("m")).when(F.col("s") < -40, F.col("g")).otherwise(color.half(F.col("m") + F.col("g")))
    return df.groupBy("img", "ch").agg(F.sum(F.abs(F.col("v") - F.col("g"))).alias("l1_graded"), F.sum(F.abs(F.col("v") - mixed)).alias("l1_mixed"))


@R.add(sql.q(*E_TP, "SELECT img, ch, CAST(sum(abs(v - coalesce(t, 0))) AS BIGINT) AS top, CAST(sum(abs(v - ((coalesce(t, 0) + coalesce(tl, 0)) >> 1))) AS BIGINT) AS avg_top, CAST(sum(abs(v - (coalesce(t, 0) + ((coalesce(tl, 0) - coalesce(tr, 0)) >> 1)))) AS BIGINT) AS grad FROM tp GROUP BY ALL"))
def row_predictors(spark: SparkSession, d: str) -> DataFrame:
    """Predictors that look at the row above only, so that a row is one vector."""
    df = neighbors.all_zero(neighbors.raw_taps(base.planes(spark, d), ("t", "tl", "tr")))
    v, t, tl, tr = (F.col(x) for x in ("v", "t", "tl", "tr"))
    return df.groupBy("img", "ch").agg(F.sum(F.abs(v - t)).alias("top"), F.sum(F.abs(v - color.half(t + tl))).alias("avg_top"), F.sum(F.abs(v - (t + color.half(tl - tr)))).alias("grad"))


_LAGS = (2, 3, 4, 6, 8)
_FAR = {**{f"L{k}": f"coalesce(lag(v, {k}) OVER wr, 0)" for k in _LAGS}, **{f"T{k}": f"coalesce(lag(v, {k}) OVER wc, 0)" for k in (*_LAGS, 12, 16, 24)}}


@R.add(sql.q(*E_YC, "f AS (SELECT img, ch, v, " + ", ".join(f"{x} AS {n}" for n, x in _FAR.items()) + " FROM pl WINDOW wr AS (PARTITION BY img, ch, i ORDER BY j), wc AS (PARTITION BY img, ch, j ORDER BY i))", " UNION ALL ".join(f"SELECT img, ch, '{n}' AS expert, CAST(sum(abs(v - {n})) AS BIGINT) AS l1 FROM f GROUP BY ALL" for n in _FAR)))
def far_lags(spark: SparkSession, d: str) -> DataFrame:
    """Samples far to the left and far above as predictors."""
    rows = neighbors.stacked(base.planes(spark, d), 24)
    tops = [k for k in (*_LAGS, 12, 16, 24)]
    cell = lambda v, j: F.struct(v.alias("v"), *[F.coalesce(F.get("row", j - k), F.lit(0)).alias(f"L{k}") for k in _LAGS], *[F.coalesce(F.get(f"u{k}", j), F.lit(0)).alias(f"T{k}") for k in tops])
    df = rows.select("img", "ch", F.inline(F.transform("row", cell)))
    sums = df.groupBy("img", "ch").agg(*[F.sum(F.abs(F.col("v") - F.col(n))).alias(n) for n in _FAR])
    return sums.select("img", "ch", F.inline(F.array(*[F.struct(F.lit(n).alias("expert"), F.col(n).alias("l1")) for n in _FAR])))


def _lag(k: int, way: str) -> str:
    """The sample k back, or the farthest there is; at the very edge the one across (copied borders)."""
    chain = [f"lag(v, {n}) OVER {way}" for n in range(k, 0, -1)]
    return f"coalesce({', '.join(chain)}, lag(v, 1) OVER {'wc' if way == 'wr' else 'wr'}, 0)"


_LINES = ", ".join([f"{_lag(k, 'wr')} AS l{k}" for k in (1, 2, 3, 4, 8)] + [f"{_lag(k, 'wc')} AS t{k}" for k in (1, 2, 3, 4)])
_FAR_BANK = {"WL2": "l2", "WL4": "l4", "WL8": "l8", "WN2": "t2", "WN4": "t4", "HAVG4": "(l1 + l2 + l3 + l4) >> 2", "VAVG4": "(t1 + t2 + t3 + t4) >> 2", "XH": "2 * l1 - l2", "XV": "2 * t1 - t2", "XH4": "2 * l1 - l4", "NW2": "coalesce(nw, CASE WHEN i < 2 THEN t1 ELSE l1 END)", "NE2": "coalesce(ne, t1)"}


@R.add(sql.q(*E_YC, "f0 AS (SELECT *, lag(v, 2) OVER (PARTITION BY img, ch, j ORDER BY i) AS up2 FROM pl)", f"f AS (SELECT img, ch, i, j, v, {_LINES}, lag(up2, 2) OVER wr AS nw, lead(up2, 2) OVER wr AS ne FROM f0 WINDOW wr AS (PARTITION BY img, ch, i ORDER BY j), wc AS (PARTITION BY img, ch, j ORDER BY i))", " UNION ALL ".join(f"SELECT img, ch, '{n}' AS expert, CAST(sum(abs(v - ({x}))) AS BIGINT) AS l1 FROM f GROUP BY ALL" for n, x in _FAR_BANK.items())))
def far_bank(spark: SparkSession, d: str) -> DataFrame:
    """Averages and extrapolations along rows and columns and far diagonals, with copied borders."""
    rows = neighbors.stacked(base.planes(spark, d), 4)

    def cell(v: Column, j: Column) -> Column:
        left, top = F.get("row", j - 1), F.get("u1", j)
        far = {f"l{k}": F.coalesce(*[F.get("row", j - n) for n in range(k, 0, -1)], top, F.lit(0)) for k in (1, 2, 3, 4, 8)}
        far |= {f"t{k}": F.coalesce(*[F.get(f"u{n}", j) for n in range(k, 0, -1)], left, F.lit(0)) for k in (1, 2, 3, 4)}
        far |= {"nw": F.get("u2", j - 2), "ne": F.get("u2", j + 2)}
        return F.struct(v.alias("v"), *[x.alias(n) for n, x in far.items()])

    df = rows.select("img", "ch", "i", F.inline(F.transform("row", cell)))
    line = lambda x: sum((F.col(f"{x}{k}") for k in (2, 3, 4)), F.col(f"{x}1"))
    guess = {"WL2": F.col("l2"), "WL4": F.col("l4"), "WL8": F.col("l8"), "WN2": F.col("t2"), "WN4": F.col("t4"), "HAVG4": color.floor_div(line("l"), 4), "VAVG4": color.floor_div(line("t"), 4)}
    guess |= {"XH": 2 * F.col("l1") - F.col("l2"), "XV": 2 * F.col("t1") - F.col("t2"), "XH4": 2 * F.col("l1") - F.col("l4"), "NW2": F.coalesce("nw", F.when(F.col("i") < 2, F.col("t1")).otherwise(F.col("l1"))), "NE2": F.coalesce("ne", "t1")}
    sums = df.groupBy("img", "ch").agg(*[F.sum(F.abs(F.col("v") - x)).alias(n) for n, x in guess.items()])
    return sums.select("img", "ch", F.inline(F.array(*[F.struct(F.lit(n).alias("expert"), F.col(n).alias("l1")) for n in guess])))


_FOUR = "list_sort([a, b, c, d])"


@R.add(sql.q(*E_TP, sql.experts(("MEDIAN4", "MEDIAN5", "GAP8", "GAP4", "AVG4"), bank={"MEDIAN4": f"({_FOUR}[2] + {_FOUR}[3]) >> 1", "MEDIAN5": "list_sort([a, b, c, d, (a + b) >> 1])[3]", "GAP8": sql.gap(8), "GAP4": sql.gap(4), "AVG4": "(a + b + c + d) >> 2"}), "SELECT img, ch, expert, CAST(sum(abs(v - p)) AS BIGINT) AS l1 FROM ex GROUP BY ALL"))
def micro_predictors(spark: SparkSession, d: str) -> DataFrame:
    df = predictors.unpivoted(base.taps(spark, d), predictors.micro())
    return df.groupBy("img", "ch", "expert").agg(F.sum(F.abs(F.col("v") - F.col("p"))).alias("l1"))


def _beside_luma(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the three channels as one row per pixel: struct columns y, co, cg with taps."""
    df = base.taps(spark, d)
    cell = F.struct("v", "a", "b", "c", "d")
    return df.groupBy("img", "i", "j").agg(*[F.max(F.when(F.col("ch") == k, cell)).alias(n) for k, n in enumerate(("y", "co", "cg"))])


def _med(of: str):
    return predictors.med(F.col(f"{of}.a"), F.col(f"{of}.b"), F.col(f"{of}.c"))


_PAIRED = f"lu AS (SELECT img, i, j, v - {sql.med()} AS dy, v AS yv, {sql.med()} AS ym, a AS ya, b AS yb, c AS yc_, d AS yd FROM b4 WHERE ch = 0), cb AS (SELECT b4.*, {sql.med('b4.a', 'b4.b', 'b4.c')} AS m, dy, ym, ya, yb, yc_, yd FROM b4 JOIN lu USING (img, i, j) WHERE ch > 0)"


@R.add(sql.q(*E_TP, _PAIRED, " UNION ALL ".join(f"SELECT img, ch, {t} AS t, CAST(sum(abs(v - (m + ((dy * {t}) >> 4)))) AS BIGINT) AS l1 FROM cb GROUP BY ALL" for t in (-4, -2, -1, 1, 2, 4))))
def luma_slope(spark: SparkSession, d: str) -> DataFrame:
    """Chroma predicted by its own neighbours plus a share of the luma's error."""
    df = _beside_luma(spark, d).withColumn("dy", F.col("y.v") - _med("y"))
    cells = [F.struct(F.lit(k).alias("ch"), F.lit(t).alias("t"), F.abs(F.col(f"{n}.v") - (_med(n) + color.floor_div(F.col("dy") * t, 16))).alias("e")) for k, n in ((1, "co"), (2, "cg")) for t in (-4, -2, -1, 1, 2, 4)]
    return df.select("img", F.inline(F.array(*cells))).groupBy("img", "ch", "t").agg(F.sum("e").alias("l1"))


def _floor_mean_sql(members: str, T: int) -> str:
    num = " + ".join(f"CASE WHEN abs(y{x if x != 'c' else 'c_'} - ym) <= {T} THEN {x} ELSE 0 END" for x in members)
    den = " + ".join(f"CASE WHEN abs(y{x if x != 'c' else 'c_'} - ym) <= {T} THEN 1 ELSE 0 END" for x in members)
    return f"CASE WHEN ({den}) > 0 THEN CAST(floor(CAST({num} AS DOUBLE) / greatest({den}, 1)) AS INTEGER) ELSE m END"


@R.add(sql.q(*E_TP, _PAIRED, f"SELECT img, ch, CAST(sum(abs(v - {_floor_mean_sql('ab', 8)})) AS BIGINT) AS b2, CAST(sum(abs(v - {_floor_mean_sql('abcd', 8)})) AS BIGINT) AS b4 FROM cb GROUP BY ALL"))
def bilateral_chroma(spark: SparkSession, d: str, threshold: int = 8) -> DataFrame:
    """Mean of the chroma neighbours whose luma is near the luma's own prediction."""
    df = _beside_luma(spark, d).withColumn("ym", _med("y"))

    def mean(n: str, members: str):
        near = {x: F.abs(F.col(f"y.{x}") - F.col("ym")) <= threshold for x in members}
        num = sum((F.when(near[x], F.col(f"{n}.{x}")).otherwise(0) for x in members), F.lit(0))
        den = sum((F.when(near[x], 1).otherwise(0) for x in members), F.lit(0))
        return F.when(den > 0, F.floor(num / F.greatest(den, F.lit(1))).cast("int")).otherwise(_med(n))

    cells = [F.struct(F.lit(k).alias("ch"), F.abs(F.col(f"{n}.v") - mean(n, "ab")).alias("e2"), F.abs(F.col(f"{n}.v") - mean(n, "abcd")).alias("e4")) for k, n in ((1, "co"), (2, "cg"))]
    return df.select("img", F.inline(F.array(*cells))).groupBy("img", "ch").agg(F.sum("e2").alias("b2"), F.sum("e4").alias("b4"))


@R.add(sql.q(*E_TP, f"r AS (SELECT img, ch, v - {sql.med()} AS r FROM b4)", "SELECT img, ch, CAST(sum(CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END) AS BIGINT) AS z0, CAST(sum(2 * abs(r) - (r > 0)::INT) AS BIGINT) AS z1, CAST(sum(CASE WHEN r >= 0 THEN r ELSE -r END) AS BIGINT) AS back FROM r GROUP BY ALL"))
def zigzag_maps(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r")
    z0, z1 = color.zigzag(r), color.zigzag_up(r)
    back = F.when(z1 % 2 == 1, color.half(z1 + 1)).otherwise(-color.half(z1))
    return base.med_residuals(spark, d).groupBy("img", "ch").agg(F.sum(z0).alias("z0"), F.sum(z1).alias("z1"), F.sum(F.abs(back)).alias("back"))


@R.add(sql.q(*E_TP, f"r AS (SELECT img, ch, v - {sql.med()} AS r FROM b4), n AS (SELECT img, ch, r, CAST(t AS INTEGER) AS tau, CAST(round_even(r / CAST(2 * t + 1 AS DOUBLE), 0) AS INTEGER) AS rq FROM r, range(3) x(t))", "SELECT img, ch, tau, CAST(sum(abs(rq)) AS BIGINT) AS l1, count(DISTINCT rq) AS symbols, max(abs(r - rq * (2 * tau + 1))) AS max_error, bool_and(abs(r - rq * (2 * tau + 1)) <= tau) AS bounded FROM n GROUP BY ALL"))
def near_lossless_open_loop(spark: SparkSession, d: str) -> DataFrame:
    """Residuals rounded (half to even) to multiples of 2 tau + 1, and the error bound."""
    r, tau, rq = F.col("r"), F.col("tau"), F.col("rq")
    df = base.med_residuals(spark, d).select("img", "ch", "r", F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("tau"))
    df = df.withColumn("rq", F.rint(r / (2 * tau + 1)).cast("int"))
    error = F.abs(r - rq * (2 * tau + 1))
    return df.groupBy("img", "ch", "tau").agg(F.sum(F.abs(rq)).alias("l1"), F.count_distinct(rq).alias("symbols"), F.max(error).alias("max_error"), F.bool_and(error <= tau).alias("bounded"))


@R.add(sql.q(*E_YC, "SELECT (y * 3 + (co + 256) * 5 + (cg + 256) * 7) & 63 AS slot, count(*) AS n FROM yc GROUP BY ALL"))
def color_hash(spark: SparkSession, d: str) -> DataFrame:
    y, co, cg = color.ycocg(*map(F.col, "rgb"))
    px = rasters.pixels(rasters.embedding_raster(spark, d))
    return px.groupBy((y * 3 + (co + 256) * 5 + (cg + 256) * 7).bitwiseAND(63).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


_MIX = "(w0 * exp(-abs(x) / greatest(s, 0.5)) / (2 * greatest(s, 0.5)) + (1 - w0) * exp(-abs(x) / greatest(4 * s, 0.5)) / (2 * greatest(4 * s, 0.5)))"


@R.add(sql.q(*E_TP, f"m AS (SELECT img, ch, avg(abs(v - {sql.med()})) AS s, CAST(0.75 AS DOUBLE) AS w0 FROM b4 GROUP BY ALL), p AS (SELECT img, ch, CAST(x AS INTEGER) AS sym, {_MIX} AS p FROM m, range(-32, 33) t(x))", "SELECT img, ch, sym, round(p / sum(p) OVER (PARTITION BY img, ch), 6) AS p FROM p"))
def laplace_mixture(spark: SparkSession, d: str, most: int = 32, w0: float = 0.75, ratio: float = 4.0) -> DataFrame:
    """Two-sided exponentials, one wider by a ratio, over -most..most; the scale is the mean magnitude of residuals."""
    from pyspark.sql import Window

    s = F.greatest(F.col("s"), F.lit(0.5))
    wide = F.greatest(F.col("s") * ratio, F.lit(0.5))
    x = F.abs("sym")
    df = base.med_residuals(spark, d).groupBy("img", "ch").agg(F.avg(F.abs("r")).alias("s"))
    df = df.select("img", "ch", "s", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("sym"))
    df = df.withColumn("p", w0 * F.exp(-x / s) / (2 * s) + (1 - w0) * F.exp(-x / wide) / (2 * wide))
    return df.select("img", "ch", "sym", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("img", "ch")), 6).alias("p"))


#: Steps of the table to one, and its last index (fixed values).
_STEPS, _LAST = 1 << 14, 1 << 17


@R.add(f"SELECT CAST(x AS INTEGER) AS idx, round(tanh(x / {_STEPS}.0), 9) AS value FROM range(0, {_LAST + 1}) t(x)")
def tanh_table(spark: SparkSession, d: str) -> DataFrame:
    """The fixed table tanh(i / 2^14), i = 0..2^17."""
    return spark.range(0, _LAST + 1).select(F.col("id").cast("int").alias("idx"), F.round(F.tanh(F.col("id") / _STEPS), 9).alias("value"))


@R.add(sql.q(*E_TP, f"hist AS (SELECT img, ch, v - {sql.med()} AS r, count(*) AS cnt FROM b4 GROUP BY ALL)", f"SELECT img, ch, round(sum(cnt * sign(r) * round(tanh(least({_LAST}, floor(abs(r) / 128.0 * {_STEPS} + 0.5)) / {_STEPS}.0), 9)), 6) AS total FROM hist GROUP BY ALL"))
def tanh_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sums of tanh(residual / 128) by look-up in the table, which saturates beyond its end."""
    hist = base.residual_rows(spark, d).select("img", "ch", F.explode("row").alias("r")).groupBy("img", "ch", "r").agg(F.count(F.lit(1)).alias("cnt"))
    at = F.least(F.lit(_LAST), F.floor(F.abs("r") / 128 * _STEPS + 0.5)).cast("int")
    met = hist.withColumn("idx", at).join(F.broadcast(tanh_table(spark, d)), "idx")  # 131,073 rows
    return met.groupBy("img", "ch").agg(F.round(F.sum(F.col("cnt") * F.signum("r") * F.col("value")), 6).alias("total"))
