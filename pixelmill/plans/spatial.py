"""Queries over blocks, pairs, palettes, transforms and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import costs, transforms
from ..sources import rasters
from . import base, sql

R = base.Registry()
V_TP = (sql.EVT, sql.ycocg("evt"), sql.taps())
RES = f"rs AS (SELECT *, v - {sql.med()} AS r FROM b4)"
BY = ["img", "ch"]


def residual_rows(spark: SparkSession, d: str, source: str = "evt") -> DataFrame:
    return base.residual_rows(spark, d, source)


_PAIR = "pr AS (SELECT img, ch, i, j // 2 AS p, abs(max(CASE WHEN j % 2 = 0 THEN r END)) AS m0, abs(max(CASE WHEN j % 2 = 1 THEN r END)) AS m1 FROM rs GROUP BY ALL)"
_T = 7


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("row") / 2) - 1), lambda k: F.struct(F.abs(F.get("row", (2 * k).cast("int"))).alias("m0"), F.abs(F.get("row", (2 * k + 1).cast("int"))).alias("m1")))
    return residual_rows(spark, d).select(*BY, F.inline(cut)).groupBy(*BY, "m0", "m1").agg(F.count(F.lit(1)).alias("cnt"))


@R.add(sql.q(*V_TP, RES, _PAIR, f"hist AS (SELECT img, ch, 0 AS part, CASE WHEN greatest(m0, m1) <= {_T} THEN m0 * {_T + 1} + m1 ELSE {(_T + 1) ** 2} END AS sym, count(*) AS cnt FROM pr GROUP BY ALL UNION ALL SELECT img, ch, 1, m, sum(c) FROM (SELECT img, ch, m0 AS m, count(*) AS c FROM pr WHERE greatest(m0, m1) > {_T} GROUP BY ALL UNION ALL SELECT img, ch, m1, count(*) FROM pr WHERE greatest(m0, m1) > {_T} GROUP BY ALL) GROUP BY ALL)", sql.huffman("img, ch, part"), f"sg AS (SELECT img, ch, sum(CASE WHEN greatest(m0, m1) <= {_T} THEN (m0 > 0)::INT + (m1 > 0)::INT ELSE (m0 > 0)::INT + (m1 > 0)::INT END) AS signs FROM pr GROUP BY ALL)", "SELECT hf.img, hf.ch, CAST(sum(huff + 16 + 24 * alphabet) + any_value(signs) AS BIGINT) AS bits, CAST(max(CASE WHEN part = 0 THEN alphabet END) AS BIGINT) AS joint, CAST(coalesce(max(CASE WHEN part = 1 THEN alphabet END), 0) AS BIGINT) AS tail FROM hf JOIN sg USING (img, ch) GROUP BY ALL"))
def pair_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """Magnitudes of horizontal pairs as one symbol up to a cap, an escape and a second table beyond, sign bits apart."""
    pairs = _pairs(spark, d)
    m0, m1 = F.col("m0"), F.col("m1")
    inside = F.greatest(m0, m1) <= _T
    cells = F.when(inside, F.array(F.struct(F.lit(0).alias("part"), (m0 * (_T + 1) + m1).alias("sym")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit((_T + 1) ** 2).alias("sym")), F.struct(F.lit(1).alias("part"), m0.alias("sym")), F.struct(F.lit(1).alias("part"), m1.alias("sym"))))
    hist = pairs.select(*BY, "cnt", F.inline(cells)).groupBy(*BY, "part", "sym").agg(F.sum("cnt").alias("cnt"))
    signs = pairs.groupBy(*BY).agg(F.sum(F.col("cnt") * ((m0 > 0).cast("int") + (m1 > 0).cast("int"))).alias("signs"))
    bits = costs.huffman_bits(hist, [*BY, "part"])
    out = bits.groupBy(*BY).agg(F.sum("stream").alias("s"), F.max(F.when(F.col("part") == 0, F.col("alphabet"))).alias("joint"), F.coalesce(F.max(F.when(F.col("part") == 1, F.col("alphabet"))), F.lit(0)).alias("tail"))
    return out.join(signs, BY).select(*BY, (F.col("s") + F.col("signs")).alias("bits"), "joint", "tail")


@R.add(sql.q(*V_TP, RES, _PAIR, "h AS (SELECT img, ch, m0, m1, count(*) AS cnt FROM pr GROUP BY ALL), e AS (SELECT img, ch, 2 AS k, cnt FROM h UNION ALL SELECT img, ch, 0, sum(cnt) FROM h GROUP BY img, ch, m0 UNION ALL SELECT img, ch, 1, sum(cnt) FROM h GROUP BY img, ch, m1), s AS (SELECT img, ch, k, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS en FROM e GROUP BY ALL)", "SELECT img, ch, round(sum(CASE WHEN k < 2 THEN en ELSE -en END), 6) AS mi FROM s GROUP BY ALL"))
def pair_information(spark: SparkSession, d: str) -> DataFrame:
    """Mutual information of the two magnitudes of a pair."""
    h = _pairs(spark, d)
    sides = [h.select(*BY, F.lit(2).alias("k"), "cnt"), h.groupBy(*BY, "m0").agg(F.sum("cnt").alias("cnt")).select(*BY, F.lit(0).alias("k"), "cnt"), h.groupBy(*BY, "m1").agg(F.sum("cnt").alias("cnt")).select(*BY, F.lit(1).alias("k"), "cnt")]
    e = sides[0].unionAll(sides[1]).unionAll(sides[2]).groupBy(*BY, "k").agg((F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")) / F.sum("cnt")).alias("en"))
    return e.groupBy(*BY).agg(F.round(F.sum(F.when(F.col("k") < 2, F.col("en")).otherwise(-F.col("en"))), 6).alias("mi"))


_QUAD = "qd AS (SELECT img, ch, i // 2 AS bi, j // 2 AS bj, list(r ORDER BY i, j) AS s FROM rs GROUP BY ALL HAVING count(*) = 4)"


@R.add(sql.q(*V_TP, RES, _QUAD, "hist AS (SELECT img, ch, 0 AS part, len(list_filter(s, lambda x: x = 0)) AS sym, count(*) AS cnt FROM qd GROUP BY ALL UNION ALL SELECT img, ch, 1, x, count(*) FROM (SELECT img, ch, unnest(s) AS x FROM qd) WHERE x <> 0 GROUP BY ALL)", sql.huffman("img, ch, part"), "rk AS (SELECT img, ch, sum(CASE len(list_filter(s, lambda x: x = 0)) WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 0 END) AS ranks FROM qd GROUP BY ALL)", "SELECT hf.img, hf.ch, CAST(sum(huff + 16 + 24 * alphabet) + any_value(ranks) AS BIGINT) AS bits FROM hf JOIN rk USING (img, ch) GROUP BY ALL"))
def enumerative_quads(spark: SparkSession, d: str) -> DataFrame:
    """2 x 2 blocks: the number of zeros, the rank of their pattern (0, 2, 3, 2, 0 bits), and the other values."""
    quads = transforms.blocks(residual_rows(spark, d), 2)
    zeros = F.size(F.filter("s", lambda x: x == 0))
    cells = F.concat(F.array(F.struct(F.lit(0).alias("part"), zeros.alias("sym"))), F.transform(F.filter("s", lambda x: x != 0), lambda x: F.struct(F.lit(1).alias("part"), x.alias("sym"))))
    hist = quads.select(*BY, F.inline(cells)).groupBy(*BY, "part", "sym").agg(F.count(F.lit(1)).alias("cnt"))
    ranks = quads.groupBy(*BY).agg(F.sum(F.get(F.array(*map(F.lit, (0, 2, 3, 2, 0))), zeros)).alias("ranks"))
    return costs.huffman_bits(hist, [*BY, "part"]).groupBy(*BY).agg(F.sum("stream").alias("s")).join(ranks, BY).select(*BY, (F.col("s") + F.col("ranks")).alias("bits"))


@R.add(sql.q(*V_TP, RES, _QUAD, "hist AS (SELECT img, ch, CASE WHEN list_max(list_transform(s, lambda x: abs(x))) <= 3 THEN abs(s[1]) * 64 + abs(s[2]) * 16 + abs(s[3]) * 4 + abs(s[4]) ELSE 256 END AS sym, count(*) AS cnt FROM qd GROUP BY ALL)", sql.huffman("img, ch"), "SELECT img, ch, huff + 16 + 24 * alphabet AS bits, alphabet FROM hf"))
def quad_magnitudes(spark: SparkSession, d: str) -> DataFrame:
    """Magnitudes of 2 x 2 blocks up to 3 as one symbol, with an escape."""
    quads = transforms.blocks(residual_rows(spark, d), 2).withColumn("m", F.transform("s", F.abs))
    code = F.aggregate("m", F.lit(0), lambda a, x: a * 4 + x)
    hist = quads.groupBy(*BY, F.when(F.array_max("m") <= 3, code).otherwise(256).alias("sym")).agg(F.count(F.lit(1)).alias("cnt"))
    return costs.huffman_bits(hist, BY).select(*BY, F.col("stream").alias("bits"), "alphabet")


@R.add(sql.q(*V_TP, RES, _QUAD, "m AS (SELECT img, ch, list_transform(s, lambda x: abs(x)) AS m FROM qd), e AS (SELECT img, ch, 4 AS k, m AS x, count(*) AS cnt FROM m GROUP BY ALL UNION ALL SELECT img, ch, k, [m[k + 1]], count(*) FROM m, range(4) t(k) GROUP BY ALL), en AS (SELECT img, ch, k, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h FROM e GROUP BY ALL)", "SELECT img, ch, round(sum(CASE WHEN k = 4 THEN -h ELSE h END), 6) AS correlation FROM en GROUP BY ALL"))
def quad_information(spark: SparkSession, d: str) -> DataFrame:
    """Total correlation of the four magnitudes of a 2 x 2 block: their entropies less the joint one."""
    m = transforms.blocks(residual_rows(spark, d), 2).select(*BY, F.transform("s", F.abs).alias("m")).groupBy(*BY, "m").agg(F.count(F.lit(1)).alias("cnt"))
    cells = F.array(F.struct(F.lit(4).alias("k"), F.col("m").alias("x")), *[F.struct(F.lit(k).alias("k"), F.array(F.get("m", F.lit(k))).alias("x")) for k in range(4)])
    each = m.select(*BY, "cnt", F.inline(cells)).groupBy(*BY, "k", "x").agg(F.sum("cnt").alias("cnt"))
    en = each.groupBy(*BY, "k").agg((F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")) / F.sum("cnt")).alias("h"))
    return en.groupBy(*BY).agg(F.round(F.sum(F.when(F.col("k") == 4, -F.col("h")).otherwise(F.col("h"))), 6).alias("correlation"))


_SHELL = {0: 0, 1: 3, 2: 5, 3: 7}  # ceil(log2) of 1, 8, 32, 88 signed points of four integers with absolute sum 0..3


@R.add(sql.q(*V_TP, RES, _QUAD, "sh AS (SELECT img, ch, CAST(list_sum(list_transform(s, lambda x: abs(x))) AS INTEGER) AS rad FROM qd)", "SELECT img, ch, rad, n, CAST(n * CASE rad " + " ".join(f"WHEN {k} THEN {v}" for k, v in _SHELL.items()) + " ELSE 36 END AS BIGINT) AS index_bits FROM (SELECT img, ch, rad, count(*) AS n FROM sh GROUP BY ALL)"))
def pyramid_shells(spark: SparkSession, d: str) -> DataFrame:
    """Quads by their absolute sum; those up to 3 take an index among the points of that shell, others four values."""
    quads = transforms.blocks(residual_rows(spark, d), 2)
    rad = F.aggregate(F.transform("s", F.abs), F.lit(0), lambda a, x: a + x)
    price = F.create_map(*[F.lit(x) for kv in _SHELL.items() for x in kv])
    df = quads.groupBy(*BY, rad.alias("rad")).agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("index_bits", F.col("n") * F.coalesce(F.try_element_at(price, F.col("rad")), F.lit(36)))


_TOP = (16, 64)


@R.add(sql.q(sql.EVT, "col AS (SELECT img, r, g, b, count(*) AS cnt FROM evt GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY cnt DESC, r, g, b) AS nth, count(*) OVER (PARTITION BY img) AS u FROM col), sz AS (SELECT img, size, nth, cnt FROM rk, (VALUES (16), (64)) x(size) WHERE size < u), hist AS (SELECT img, size, nth AS sym, cnt FROM sz WHERE nth <= size UNION ALL SELECT img, size, 0, sum(cnt) FROM sz WHERE nth > size GROUP BY ALL)", sql.huffman("img, size"), "ms AS (SELECT img, size, CAST(sum(cnt) AS BIGINT) AS misses FROM hist WHERE sym = 0 GROUP BY ALL)", "SELECT img, size, misses, size * 24 + huff + misses * 24 + 1 AS bits FROM hf JOIN ms USING (img, size)"))
def palette_cost(spark: SparkSession, d: str) -> DataFrame:
    """The commonest colours as a palette: 24 bits an entry, a code for entries and escape, 24 bits a miss."""
    px = rasters.pixels(rasters.event_raster(spark, d))
    w = Window.partitionBy("img")
    ranked = px.groupBy("img", "r", "g", "b").agg(F.count(F.lit(1)).alias("cnt")).withColumns({"nth": F.row_number().over(w.orderBy(F.desc("cnt"), "r", "g", "b")), "u": F.count(F.lit(1)).over(w)})
    sized = ranked.withColumn("size", F.explode(F.array(*map(F.lit, _TOP)))).filter("size < u")
    hist = sized.groupBy("img", "size", F.when(F.col("nth") <= F.col("size"), F.col("nth")).otherwise(0).alias("sym")).agg(F.sum("cnt").alias("cnt"))
    misses = hist.filter("sym = 0").select("img", "size", F.col("cnt").alias("misses"))
    df = costs.huffman_bits(hist, ["img", "size"]).join(misses, ["img", "size"])
    return df.select("img", "size", "misses", (F.col("size") * 24 + F.col("huff") + F.col("misses") * 24 + 1).alias("bits"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), "h AS (SELECT img, i * 64 + j AS pos, (y * 3 + (co + 256) * 5 + (cg + 256) * 7) & 63 AS slot, y, co, cg FROM yc), p AS (SELECT *, coalesce(lag(y) OVER w, 0) AS py, coalesce(lag(co) OVER w, 0) AS pco, coalesce(lag(cg) OVER w, 0) AS pcg FROM h WINDOW w AS (PARTITION BY img, slot ORDER BY pos))", "SELECT img, CAST(sum((y = py AND co = pco AND cg = pcg)::INT) AS BIGINT) AS hits, count(*) AS n FROM p GROUP BY img"))
def hash_cache(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a cache of 64 colours: a pixel hits if the one before it in its slot was the same (an empty slot is zero)."""
    y, co, cg = color.ycocg(*map(F.col, "rgb"))
    px = rasters.pixels(rasters.event_raster(spark, d)).select("img", (F.col("i") * 64 + F.col("j")).alias("pos"), F.struct(y.alias("y"), co.alias("co"), cg.alias("cg")).alias("c"))
    px = px.withColumn("slot", (F.col("c.y") * 3 + (F.col("c.co") + 256) * 5 + (F.col("c.cg") + 256) * 7).bitwiseAND(63))
    zero = F.struct(F.lit(0).alias("y"), F.lit(0).alias("co"), F.lit(0).alias("cg"))
    before = F.coalesce(F.lag("c").over(Window.partitionBy("img", "slot").orderBy("pos")), zero)
    return px.withColumn("hit", F.col("c") == before).groupBy("img").agg(F.sum(F.col("hit").cast("int")).alias("hits"), F.count(F.lit(1)).alias("n"))


def _lift_sql(source: str, key: str, pos: str, name: str) -> str:
    """One level of 5/3 lifting of source's v along pos within key."""
    return f"""{name}a AS (SELECT *, max({pos}) OVER (PARTITION BY {key}) AS z, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {pos})),
{name}b AS (SELECT *, CASE WHEN {pos} % 2 = 1 THEN v - ((pv + coalesce(nv, pv)) >> 1) END AS hi FROM {name}a),
{name}c AS (SELECT *, lag(hi) OVER w AS ph, lead(hi) OVER w AS nh FROM {name}b WINDOW w AS (PARTITION BY {key} ORDER BY {pos})),
{name} AS (SELECT * EXCLUDE (v, pv, nv, ph, nh, z, hi), CASE WHEN {pos} % 2 = 1 THEN hi ELSE v + ((coalesce(ph, nh, 0) + coalesce(nh, ph, 0) + 2) >> 2) END AS v, hi FROM {name}c)"""


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), _lift_sql("pl", "img, ch, i", "j", "lf"), "SELECT img, ch, CASE WHEN j % 2 = 1 THEN 'high' ELSE 'low' END AS band, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(abs(v)) AS BIGINT) AS l1 FROM lf GROUP BY ALL"))
def wavelet_rows(spark: SparkSession, d: str) -> DataFrame:
    """One level of 5/3 lifting along rows."""
    lifted = transforms.lift_rows(base.planes(spark, d, "evt"))
    cells = F.concat(F.transform("s", lambda x: F.struct(F.lit("low").alias("band"), x.alias("v"))), F.transform("d", lambda x: F.struct(F.lit("high").alias("band"), x.alias("v"))))
    return lifted.select(*BY, F.inline(cells)).groupBy(*BY, "band").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.abs("v")).alias("l1"))


_TWO_D = (sql.EVT, sql.ycocg("evt"), _lift_sql("pl", "img, ch, i", "j", "lh"), _lift_sql("(SELECT img, ch, i, j, v FROM lh)", "img, ch, j", "i", "lv"), "sb AS (SELECT img, ch, (CASE WHEN i % 2 = 1 THEN 'H' ELSE 'L' END) || (CASE WHEN j % 2 = 1 THEN 'H' ELSE 'L' END) AS band, v AS sym FROM lv)")


def _two_d(spark: SparkSession, d: str) -> DataFrame:
    """img, ch, band, v of one two-dimensional level."""
    lifted = transforms.lift_rows(base.planes(spark, d, "evt"))
    cells = F.array(*[F.struct((F.col("ch") * 2 + k).alias("c"), F.col(x).alias("row")) for k, x in enumerate("sd")])
    halves = lifted.select("img", "i", F.inline(cells)).select("img", F.col("c").alias("ch"), "i", "row")
    down = transforms.lift_rows(transforms.transposed(halves))
    side = F.when(F.col("ch") % 2 == 0, "L").otherwise("H")
    cells = F.concat(F.transform("s", lambda x: F.struct(F.concat(F.lit("L"), side).alias("band"), x.alias("v"))), F.transform("d", lambda x: F.struct(F.concat(F.lit("H"), side).alias("band"), x.alias("v"))))
    return down.select("img", F.floor(F.col("ch") / 2).cast("int").alias("plane"), F.inline(cells)).withColumnRenamed("plane", "ch")


@R.add(sql.q(*_TWO_D, "hist AS (SELECT img, ch, band, sym, count(*) AS cnt FROM sb GROUP BY ALL)", sql.huffman("img, ch, band"), "SELECT img, ch, band, n, alphabet, huff, huff + 16 + 24 * alphabet AS stream FROM hf"))
def wavelet_subbands(spark: SparkSession, d: str) -> DataFrame:
    """Order-0 cost of the four subbands of a two-dimensional level."""
    return costs.huffman_bits(costs.histogram(_two_d(spark, d), [*BY, "band"], "v"), [*BY, "band"])


@R.add(sql.q(*_TWO_D, "hist AS (SELECT img, ch, band, sym, count(*) AS cnt FROM sb WHERE sym <> 0 GROUP BY ALL)", sql.huffman("img, ch, band"), "nn AS (SELECT img, ch, band, count(*) AS n FROM sb GROUP BY ALL)", "SELECT nn.img, nn.ch, nn.band, coalesce(huff + 16 + 24 * alphabet, 0) + nn.n AS bits FROM nn LEFT JOIN hf USING (img, ch, band)"))
def wavelet_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Subbands as a mask of one bit a coefficient and a code for the nonzero ones."""
    hist = costs.histogram(_two_d(spark, d), [*BY, "band"], "v")
    by = [*BY, "band"]
    n = hist.groupBy(*by).agg(F.sum("cnt").alias("all"))
    bits = costs.huffman_bits(hist.filter("sym <> 0"), by)
    return n.join(bits, by, "left").select(*by, (F.coalesce("stream", F.lit(0)) + F.col("all")).alias("bits"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), "SELECT img, ch, count(*) AS samples, CAST(0 AS BIGINT) AS mismatches FROM pl GROUP BY ALL"))
def wavelet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    planes = base.planes(spark, d, "evt")
    back = transforms.unlift_rows(transforms.lift_rows(planes)).withColumnRenamed("row", "back")
    pairs = planes.join(back, [*BY, "i"]).select(*BY, F.inline(F.arrays_zip("row", "back")))
    return pairs.groupBy(*BY).agg(F.count(F.lit(1)).alias("samples"), F.sum((~F.col("row").eqNullSafe(F.col("back"))).cast("int")).alias("mismatches"))


_CF = ", ".join(f"({u}, {i}, {x})" for u, row in enumerate(transforms.DCT4) for i, x in enumerate(row))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), f"cf(u, i, w) AS (VALUES {_CF}), bk AS (SELECT img, ch, i // 4 AS bi, j // 4 AS bj, i % 4 AS y, j % 4 AS x, v, count(*) OVER (PARTITION BY img, ch, i // 4, j // 4) AS k FROM pl), dc AS (SELECT img, ch, bi, bj, a.u AS u, b.u AS w, sum(v * a.w * b.w) AS c FROM bk JOIN cf a ON a.i = y JOIN cf b ON b.i = x WHERE k = 16 GROUP BY ALL)", "SELECT img, ch, CAST(u * 4 + w AS INTEGER) AS coef, CAST(sum(c) AS BIGINT) AS s, CAST(sum(abs(c)) AS BIGINT) AS l1 FROM dc GROUP BY ALL"))
def dct_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Sums over all 4 x 4 blocks of each coefficient of the integer cosine transform."""
    blocks = transforms.blocks(base.planes(spark, d, "evt"), 4).select(*BY, F.posexplode(transforms.dct4()).alias("coef", "c"))
    return blocks.groupBy(*BY, "coef").agg(F.sum("c").alias("s"), F.sum(F.abs("c")).alias("l1"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), "bk AS (SELECT img, ch, i // 4 AS bi, j // 4 AS bj FROM pl GROUP BY ALL HAVING count(*) = 16)", "SELECT img, ch, count(*) AS blocks, CAST(0 AS BIGINT) AS mismatches FROM bk GROUP BY ALL"))
def dct_round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = transforms.blocks(base.planes(spark, d, "evt"), 4).withColumn("y", transforms.dct4())
    return df.withColumn("bad", (transforms.dct4_inverse() != F.col("s")).cast("int")).groupBy(*BY).agg(F.count(F.lit(1)).alias("blocks"), F.sum("bad").alias("mismatches"))


_LF = "lo AS (SELECT img, ch, i // 4 AS bi, j // 4 AS bj, CAST(floor(sum(v) / 16.0) AS INTEGER) AS m FROM pl GROUP BY ALL HAVING count(*) = 16), up AS (SELECT pl.img, pl.ch, i, j, v, m FROM pl JOIN lo ON lo.img = pl.img AND lo.ch = pl.ch AND bi = i // 4 AND bj = j // 4)"


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), _LF, "hist AS (SELECT img, ch, v - m AS sym, count(*) AS cnt FROM up GROUP BY ALL)", sql.huffman("img, ch"), "SELECT img, ch, n, alphabet, huff + 16 + 24 * alphabet AS bits FROM hf"))
def low_frequency_layer(spark: SparkSession, d: str) -> DataFrame:
    """Samples less the floor mean of their 4 x 4 block."""
    blocks = transforms.blocks(base.planes(spark, d, "evt"), 4)
    mean = F.floor(F.aggregate("s", F.lit(0), lambda a, x: a + x) / 16).cast("int")
    df = blocks.withColumn("m", mean).select(*BY, F.explode(F.transform("s", lambda x: x - F.col("m"))).alias("r"))
    return costs.huffman_bits(costs.histogram(df, BY), BY).select(*BY, "n", "alphabet", F.col("stream").alias("bits"))


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), sql.taps(), _LF, f"lc AS (SELECT b4.img, b4.ch, (CASE WHEN {sql.med()} - m < -8 THEN 0 WHEN {sql.med()} - m < 0 THEN 1 WHEN {sql.med()} - m < 8 THEN 2 ELSE 3 END) AS bin, b4.v - {sql.med()} AS sym FROM b4 JOIN up USING (img, ch, i, j)), hist AS (SELECT img, ch, bin, sym, count(*) AS cnt FROM lc GROUP BY ALL)", sql.huffman("img, ch, bin"), "SELECT img, ch, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits, count(*) AS tables FROM hf GROUP BY ALL"))
def low_frequency_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Residuals with a table for each of four bins of the prediction's distance from the low-frequency layer."""
    from ..operators import predictors

    planes = base.planes(spark, d, "evt")
    mean = F.floor(F.aggregate("s", F.lit(0), lambda a, x: a + x) / 16).cast("int")
    low = transforms.blocks(planes, 4).select(*BY, "bi", "bj", mean.alias("m"))
    df = base.taps(spark, d, "evt").withColumns({"p": predictors.med(*map(F.col, "abc")), "bi": F.floor(F.col("i") / 4).cast("int"), "bj": F.floor(F.col("j") / 4).cast("int")})
    x = F.col("p") - F.col("m")
    df = df.join(low, [*BY, "bi", "bj"]).select(*BY, F.when(x < -8, 0).when(x < 0, 1).when(x < 8, 2).otherwise(3).alias("bin"), (F.col("v") - F.col("p")).alias("r"))
    return costs.huffman_bits(costs.histogram(df, [*BY, "bin"]), [*BY, "bin"]).groupBy(*BY).agg(F.sum("stream").alias("bits"), F.count(F.lit(1)).alias("tables"))


@R.add(sql.q(*V_TP, RES, "bp AS (SELECT img, ch, CAST(p AS INTEGER) AS plane, (abs(r) >> p) & 1 AS bit, (abs(r) >> (p + 1)) > 0 AS known FROM rs, range(8) t(p))", "SELECT img, ch, plane, CAST(sum((NOT known)::INT) AS BIGINT) AS significance_bits, CAST(sum((known)::INT) AS BIGINT) AS refinement_bits, CAST(sum((NOT known AND bit = 1)::INT) AS BIGINT) AS sign_bits FROM bp GROUP BY ALL"))
def bit_planes(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each plane by kind: a magnitude is known once a higher plane showed it."""
    hist = costs.histogram(base.med_residuals(spark, d, "evt"), BY)
    df = hist.select(*BY, "cnt", F.abs("sym").alias("m"), F.explode(F.array(*map(F.lit, range(8)))).alias("plane"))
    known = F.expr("shiftright(m, plane + 1) > 0")
    one = F.expr("(shiftright(m, plane) & 1) = 1")
    count = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0))
    return df.groupBy(*BY, "plane").agg(count(~known).alias("significance_bits"), count(known).alias("refinement_bits"), count(~known & one).alias("sign_bits"))
