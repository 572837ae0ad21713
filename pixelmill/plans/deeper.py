"""More native queries: refined groupings, block costs and bit accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import contexts, costs, grouping, predictors, transforms
from . import base, search, spatial, sql

R = base.Registry()
BY = ["img", "ch"]
E_TP = (sql.EMB, sql.ycocg(), sql.taps())
V_TP = (sql.EVT, sql.ycocg("evt"), sql.taps())
RES = f"rs AS (SELECT *, v - {sql.med()} AS r FROM b4)"
_T = 4


@R.add(sql.q(*V_TP, RES, f"pr AS (SELECT img, ch, i, j // 2 AS p, max(CASE WHEN j % 2 = 0 THEN r END) AS x, max(CASE WHEN j % 2 = 1 THEN r END) AS y FROM rs GROUP BY ALL), hist AS (SELECT img, ch, 0 AS part, CASE WHEN greatest(abs(x), abs(y)) <= {_T} THEN (x + {_T}) * {2 * _T + 1} + y + {_T} ELSE {(2 * _T + 1) ** 2} END AS sym, count(*) AS cnt FROM pr GROUP BY ALL UNION ALL SELECT img, ch, 1, v, sum(c) FROM (SELECT img, ch, x AS v, count(*) AS c FROM pr WHERE greatest(abs(x), abs(y)) > {_T} GROUP BY ALL UNION ALL SELECT img, ch, y, count(*) FROM pr WHERE greatest(abs(x), abs(y)) > {_T} GROUP BY ALL) GROUP BY ALL)", sql.huffman("img, ch, part"), "SELECT img, ch, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits FROM hf GROUP BY ALL"))
def signed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signed horizontal pairs as one symbol up to a cap, an escape and a second table beyond."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("row") / 2) - 1), lambda k: F.struct(F.get("row", (2 * k).cast("int")).alias("x"), F.get("row", (2 * k + 1).cast("int")).alias("y")))
    pairs = spatial.residual_rows(spark, d).select(*BY, F.inline(cut)).groupBy(*BY, "x", "y").agg(F.count(F.lit(1)).alias("cnt"))
    x, y = F.col("x"), F.col("y")
    inside = F.greatest(F.abs(x), F.abs(y)) <= _T
    entry = lambda part, s: F.struct(F.lit(part).alias("part"), s.cast("int").alias("sym"))
    cells = F.when(inside, F.array(entry(0, (x + _T) * (2 * _T + 1) + y + _T))).otherwise(F.array(entry(0, F.lit((2 * _T + 1) ** 2)), entry(1, x), entry(1, y)))
    hist = pairs.select(*BY, "cnt", F.inline(cells)).groupBy(*BY, "part", "sym").agg(F.sum("cnt").alias("cnt"))
    return costs.huffman_bits(hist, [*BY, "part"]).groupBy(*BY).agg(F.sum("stream").alias("bits"))


_E9 = "least((abs(a - c) + abs(b - c)) >> 4, 8)"


@R.add(sql.q(*V_TP, f"g AS (SELECT img, ch, i, j, {_E9} // 3 AS g, v - {sql.med()} AS r FROM b4), pr AS (SELECT img, ch, i, j // 2 AS p, max(CASE WHEN j % 2 = 0 THEN g END) AS g0, max(CASE WHEN j % 2 = 1 THEN g END) AS g1, max(CASE WHEN j % 2 = 0 THEN r END) AS x, max(CASE WHEN j % 2 = 1 THEN r END) AS y FROM g GROUP BY ALL), hist AS (SELECT img, ch, g0 AS g, 0 AS kind, x * 4096 + y AS sym, count(*) AS cnt FROM pr WHERE g0 = g1 GROUP BY ALL UNION ALL SELECT img, ch, g, 1, r, sum(c) FROM (SELECT img, ch, g0 AS g, x AS r, count(*) AS c FROM pr WHERE g0 <> g1 GROUP BY ALL UNION ALL SELECT img, ch, g1, y, count(*) FROM pr WHERE g0 <> g1 GROUP BY ALL) GROUP BY ALL)", sql.huffman("img, ch, g, kind"), "SELECT img, ch, CAST(sum(huff + 16 + CASE WHEN kind = 0 THEN 48 ELSE 24 END * alphabet) AS BIGINT) AS bits FROM hf GROUP BY ALL"))
def homogeneous_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose two samples are of one group share a symbol; the others are coded one by one in their groups."""
    df = base.med_residuals(spark, d, "evt").withColumn("g", F.floor(contexts.energy9(*map(F.col, "abc")) / 3).cast("int"))
    rows = df.groupBy(*BY, "i").agg(F.array_sort(F.collect_list(F.struct("j", "g", "r"))).alias("p"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2) - 1), lambda k: F.struct(F.get("p", (2 * k).cast("int")).alias("s"), F.get("p", (2 * k + 1).cast("int")).alias("t")))
    pairs = rows.select(*BY, F.inline(cut)).groupBy(*BY, F.col("s.g").alias("g0"), F.col("t.g").alias("g1"), F.col("s.r").alias("x"), F.col("t.r").alias("y")).agg(F.count(F.lit(1)).alias("cnt"))
    entry = lambda g, kind, s: F.struct(g.alias("g"), F.lit(kind).alias("kind"), s.cast("int").alias("sym"))
    cells = F.when(F.col("g0") == F.col("g1"), F.array(entry(F.col("g0"), 0, F.col("x") * 4096 + F.col("y")))).otherwise(F.array(entry(F.col("g0"), 1, F.col("x")), entry(F.col("g1"), 1, F.col("y"))))
    hist = pairs.select(*BY, "cnt", F.inline(cells)).groupBy(*BY, "g", "kind", "sym").agg(F.sum("cnt").alias("cnt"))
    bits = costs.huffman_bits(hist, [*BY, "g", "kind"])
    return bits.groupBy(*BY).agg(F.sum(F.col("huff") + 16 + F.when(F.col("kind") == 0, 48).otherwise(24) * F.col("alphabet")).alias("bits"))


_LF = "lo AS (SELECT img, ch, i // 4 AS bi, j // 4 AS bj, CAST(floor(sum(v) / 16.0) AS INTEGER) AS m FROM pl GROUP BY ALL HAVING count(*) = 16)"


@R.add(sql.q(sql.EVT, sql.ycocg("evt"), _LF, "nb AS (SELECT lo.img, lo.ch, lo.bi, lo.bj, lo.m, coalesce(r.m, lo.m) AS mr, coalesce(d.m, lo.m) AS md FROM lo LEFT JOIN lo r ON r.img = lo.img AND r.ch = lo.ch AND r.bi = lo.bi AND r.bj = lo.bj + 1 LEFT JOIN lo d ON d.img = lo.img AND d.ch = lo.ch AND d.bi = lo.bi + 1 AND d.bj = lo.bj), up AS (SELECT pl.img, pl.ch, v - ((m * (8 - i % 4 - j % 4) + mr * (j % 4) + md * (i % 4) + 4) >> 3) AS r FROM pl JOIN nb ON nb.img = pl.img AND nb.ch = pl.ch AND bi = i // 4 AND bj = j // 4), hist AS (SELECT img, ch, r AS sym, count(*) AS cnt FROM up GROUP BY ALL)", sql.huffman("img, ch"), "SELECT img, ch, n, huff + 16 + 24 * alphabet AS bits FROM hf"))
def low_frequency_ramps(spark: SparkSession, d: str) -> DataFrame:
    """Samples less a ramp between their block's floor mean and those of the blocks to the right and below."""
    blocks = transforms.blocks(base.planes(spark, d, "evt"), 4)
    mean = F.floor(F.aggregate("s", F.lit(0), lambda a, x: a + x) / 16).cast("int")
    df = blocks.withColumn("m", mean)
    right = F.lead(F.struct("bj", "m")).over(Window.partitionBy(*BY, "bi").orderBy("bj"))
    below = F.lead(F.struct("bi", "m")).over(Window.partitionBy(*BY, "bj").orderBy("bi"))
    df = df.select("*", right.alias("rt"), below.alias("dn"))
    df = df.withColumns({"mr": F.when(F.col("rt.bj") == F.col("bj") + 1, F.col("rt.m")).otherwise(F.col("m")), "md": F.when(F.col("dn.bi") == F.col("bi") + 1, F.col("dn.m")).otherwise(F.col("m"))})
    ramp = lambda k: F.shiftright(F.col("m") * (8 - F.floor(k / 4) - k % 4) + F.col("mr") * (k % 4) + F.col("md") * F.floor(k / 4) + 4, 3)
    flat = df.select(*BY, F.explode(F.transform("s", lambda x, k: x - ramp(k).cast("int"))).alias("r"))
    return costs.huffman_bits(costs.histogram(flat, BY), BY).select(*BY, "n", F.col("stream").alias("bits"))


@R.add(sql.q(*spatial._TWO_D, "hh AS (SELECT img, ch, i // 2 AS y, j // 2 AS x, max(CASE WHEN i % 2 = 0 AND j % 2 = 0 THEN v END) AS ll, max(CASE WHEN i % 2 = 1 AND j % 2 = 1 THEN v END) AS h FROM lv GROUP BY ALL), lp AS (SELECT *, lag(ll) OVER (PARTITION BY img, ch, y ORDER BY x) AS pl_ FROM hh), hist AS (SELECT img, ch, CASE WHEN abs(ll - coalesce(pl_, ll)) < 4 THEN 0 WHEN abs(ll - coalesce(pl_, ll)) < 16 THEN 1 ELSE 2 END AS act, h AS sym, count(*) AS cnt FROM lp WHERE h IS NOT NULL GROUP BY ALL)", sql.huffman("img, ch, act"), "SELECT img, ch, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits, count(*) AS tables FROM hf GROUP BY ALL"))
def wavelet_conditioned(spark: SparkSession, d: str) -> DataFrame:
    """The diagonal subband with a table for each of three activities of the low subband beside it."""
    low = _band(spark, d, "L")
    high = _band(spark, d, "H")
    cells = low.join(high, ["img", "ch", "x"]).select("img", "ch", "x", F.inline(F.arrays_zip(F.col("s").alias("ll"), F.col("d").alias("h"), F.sequence(F.lit(0), F.size("s") - 1).alias("y")))).filter("h is not null")
    before = F.lag("ll").over(Window.partitionBy(*BY, "y").orderBy("x"))
    step = F.abs(F.col("ll") - F.coalesce(before, F.col("ll")))
    df = cells.select(*BY, F.when(step < 4, 0).when(step < 16, 1).otherwise(2).alias("act"), F.col("h").alias("r"))
    return costs.huffman_bits(costs.histogram(df, [*BY, "act"]), [*BY, "act"]).groupBy(*BY).agg(F.sum("stream").alias("bits"), F.count(F.lit(1)).alias("tables"))


def _band(spark: SparkSession, d: str, side: str) -> DataFrame:
    """img, ch, x and the vertical halves (s for L, d for H) of the low or high horizontal half of every image."""
    rows = transforms.lift_rows(base.planes(spark, d, "evt")).select(*BY, "i", F.col("s" if side == "L" else "d").alias("row"))
    down = transforms.lift_rows(transforms.transposed(rows))
    return down.select(*BY, F.col("i").alias("x"), "s" if side == "L" else "d")


@R.add(sql.q(*E_TP, sql.LOCO, search.CUBE, "en AS (SELECT img, ch, key, sum(cnt) AS c, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h FROM cube GROUP BY ALL), rk AS (SELECT *, sum(c) OVER (PARTITION BY img, ch ORDER BY round(h, 9), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(c) OVER (PARTITION BY img, ch) AS total FROM en)", "SELECT img, ch, key, CAST(least(5, coalesce(before, 0) * 6 // total) AS INTEGER) AS grp FROM rk"))
def entropy_sorted_groups(spark: SparkSession, d: str, k: int = 6) -> DataFrame:
    """Keys in order of their own entropy, cut where the running weight passes a share."""
    cube = search.key_cube(spark, d)
    en = cube.groupBy(*BY, "key").agg(F.sum("cnt").alias("c"), F.round(F.log2(F.sum("cnt")) - F.sum(F.col("cnt") * F.log2("cnt")) / F.sum("cnt"), 9).alias("h"))
    w = Window.partitionBy(*BY)
    before = F.coalesce(F.sum("c").over(w.orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return en.select(*BY, "key", F.least(F.lit(k - 1), F.floor(before * k / F.sum("c").over(w))).cast("int").alias("grp"))


_GOLOMB_OF = sql.golomb("img, ch, k, grp", name="gz").replace("CAST(k AS INTEGER) AS k", "CAST(kx AS INTEGER) AS kk").replace("kk(k)", "kq(kx)").replace(">> k) + 1 + k", ">> kx) + 1 + kx")


@R.add(sql.q(*E_TP, sql.LOCO, search.CUBE, search.groups_sql(grouping.WIDE_COUNTS), "hist AS (SELECT img, ch, k, grp, sym, sum(cnt) AS cnt FROM cube JOIN qg USING (img, ch, key) GROUP BY ALL)", _GOLOMB_OF, "act AS (SELECT img, ch, count(DISTINCT key) AS active FROM cube GROUP BY ALL), gm AS (SELECT img, ch, k, grp, min(bits) AS g FROM gz GROUP BY ALL), ch1 AS (SELECT img, ch, k, CAST(sum(g) AS BIGINT) + count(*) * 6 + 752 + any_value(active) * CAST(ceil(log2(k)) AS INTEGER) AS golomb FROM gm JOIN act USING (img, ch) GROUP BY img, ch, k), short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img, ch ORDER BY golomb, k) AS nth FROM ch1) WHERE nth <= 3)", sql.huffman("img, ch, k, grp"), "ex2 AS (SELECT img, ch, k, CAST(sum(least(huff + 16 + 24 * alphabet, g + 4) + 6) + 752 + any_value(active) * CAST(ceil(log2(k)) AS INTEGER) AS BIGINT) AS bits FROM hf JOIN short USING (img, ch, k) JOIN gm USING (img, ch, k, grp) JOIN act USING (img, ch) GROUP BY img, ch, k)", sql.first("ex2", "img, ch", "bits, k", "best"), "SELECT img, ch, k, bits FROM best"))
def shortlisted_group_count(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of groups ranked by a cheap cost; the three best are costed exactly, with the cheaper coder in each group.

    Both costs have the map of the active keys and six bits a group."""
    cube = search.key_cube(spark, d)
    groups = grouping.quantile_groups(cube, BY, grouping.WIDE_COUNTS)
    hist = cube.join(groups, [*BY, "key"]).groupBy(*BY, "k", "grp", "sym").agg(F.sum("cnt").alias("cnt"))
    active = cube.groupBy(*BY).agg(F.count_distinct("key").alias("active"))
    side = 6 * F.count(F.lit(1)) + 752 + F.max("active") * grouping.bits_for(F.col("k"))
    golomb = costs.golomb_best(hist.withColumnRenamed("k", "of"), [*BY, "of", "grp"]).select(*BY, F.col("of").alias("k"), "grp", F.col("bits").alias("g")).join(F.broadcast(active), BY)
    cheap = golomb.groupBy(*BY, "k").agg((F.sum("g") + side).alias("golomb"))
    nth = F.row_number().over(Window.partitionBy(*BY).orderBy("golomb", "k"))
    short = cheap.withColumn("nth", nth).filter("nth <= 3").select(*BY, "k")
    bits = costs.huffman_bits(hist.join(short, [*BY, "k"]), [*BY, "k", "grp"]).join(golomb, [*BY, "k", "grp"])
    exact = bits.groupBy(*BY, "k").agg((F.sum(F.least("stream", F.col("g") + 4)) + side).alias("bits"))
    return grouping.cheapest(exact, BY, ("bits", "k")).select(*BY, "k", "bits")


_CONFIGS = {"none": "0", "energy": _E9, "position": "(i // 16)", "both": f"{_E9} * 4 + (i // 16)"}


@R.add(sql.q(*E_TP, "hist AS (" + " UNION ALL ".join(f"SELECT img, ch, '{n}' AS config, CAST({x} AS INTEGER) AS g, v - {sql.med()} AS sym, count(*) AS cnt FROM b4 GROUP BY ALL" for n, x in _CONFIGS.items()) + ")", sql.huffman("img, ch, config, g"), "t AS (SELECT config, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits FROM hf GROUP BY ALL)", "SELECT config, bits, bits - (SELECT bits FROM t WHERE config = 'both') AS added FROM t"))
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """What each part of a context costs when it is left out."""
    e = contexts.energy9(*map(F.col, "abc"))
    band = F.floor(F.col("i") / 16).cast("int")
    configs = {"none": F.lit(0), "energy": e, "position": band, "both": e * 4 + band}
    cells = [F.struct(F.lit(n).alias("config"), x.cast("int").alias("g")) for n, x in configs.items()]
    df = base.med_residuals(spark, d).select(*BY, "r", F.inline(F.array(*cells)))
    t = costs.huffman_bits(costs.histogram(df, [*BY, "config", "g"]), [*BY, "config", "g"]).groupBy("config").agg(F.sum("stream").alias("bits"))
    # four rows
    whole = F.max(F.when(F.col("config") == "both", F.col("bits"))).over(Window.partitionBy(F.lit(0)))
    return t.select("config", "bits", (F.col("bits") - whole).alias("added"))


@R.add(sql.q(*V_TP, "s AS (SELECT img, ch, k AS size, (i // k) * (64 // k) + j // k AS block, CAST(sum(abs(v - " + sql.med() + ")) AS BIGINT) AS m, CAST(sum(abs(v - ((a + b) >> 1))) AS BIGINT) AS p FROM b4, (VALUES (8), (16), (32), (64)) x(k) GROUP BY ALL), t AS (SELECT img, ch, size, CAST(sum(least(m, p)) AS BIGINT) + count(*) AS score FROM s GROUP BY ALL)", sql.first("t", "img, ch", "score, size", "best"), "SELECT img, ch, size, score FROM best"))
def block_size_choice(spark: SparkSession, d: str) -> DataFrame:
    """The block size at which a choice of two predictors a block, with one unit a block, errs least."""
    a, b, c = map(F.col, "abc")
    df = base.taps(spark, d, "evt").select(*BY, "i", "j", F.abs(F.col("v") - predictors.med(a, b, c)).alias("m"), F.abs(F.col("v") - color.half(a + b)).alias("p"))
    fine = df.groupBy(*BY, F.floor(F.col("i") / 8).cast("int").alias("bi"), F.floor(F.col("j") / 8).cast("int").alias("bj")).agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    # coarser blocks are sums of the finest
    cells = [F.struct(F.lit(8 * k).alias("size"), (F.floor(F.col("bi") / k) * (8 // k) + F.floor(F.col("bj") / k)).cast("int").alias("block")) for k in (1, 2, 4, 8)]
    sums = fine.select(*BY, "m", "p", F.inline(F.array(*cells))).groupBy(*BY, "size", "block").agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    score = sums.groupBy(*BY, "size").agg((F.sum(F.least("m", "p")) + F.count(F.lit(1))).alias("score"))
    return grouping.cheapest(score, BY, ("score", "size")).select(*BY, "size", "score")


@R.add(sql.q(*E_TP, sql.LOCO, search.CUBE, "SELECT img, ch, k, CAST(16 + 736 + count(DISTINCT key) * CAST(ceil(log2(k)) AS INTEGER) AS BIGINT) AS map_bits FROM cube, (VALUES (2), (6), (36), (64)) x(k) GROUP BY img, ch, k"))
def group_map_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bits of a map from keys to k groups: a mask of 729 keys in 92 bytes and an id for each active key."""
    keys = search.key_cube(spark, d).groupBy(*BY).agg(F.count_distinct("key").alias("n"))
    return keys.select(*BY, "n", F.explode(F.array(*map(F.lit, (2, 6, 36, 64)))).alias("k")).select(*BY, "k", (16 + 736 + F.col("n") * grouping.bits_for(F.col("k"))).cast("long").alias("map_bits"))


@R.add(sql.q(*V_TP, RES, "fl AS (SELECT img, ch, i, j, r = 0 AS z, row_number() OVER (PARTITION BY img, ch, i ORDER BY j) - row_number() OVER (PARTITION BY img, ch, i, r = 0 ORDER BY j) AS isle FROM rs), ru AS (SELECT img, ch, i, isle, count(*) AS len FROM fl WHERE z GROUP BY ALL)", "SELECT img, ch, count(*) AS runs, CAST(sum(len) AS BIGINT) AS covered, CAST(sum(2 * floor(log2(len + 1)) + 1) AS BIGINT) AS gamma_bits, max(len) AS longest FROM ru GROUP BY ALL"))
def zero_run_gamma(spark: SparkSession, d: str) -> DataFrame:
    """Runs of zero residuals within rows and the gamma code of their lengths plus one."""
    rows = spatial.residual_rows(spark, d)
    # lengths of runs of one row, by a fold over its samples
    start = F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("out"))
    closed = lambda s: F.when(s["now"] > 0, F.array_append(s["out"], s["now"])).otherwise(s["out"])
    fold = F.aggregate("row", start, lambda s, x: F.when(x == 0, F.struct((s["now"] + 1).alias("now"), s["out"].alias("out"))).otherwise(F.struct(F.lit(0).alias("now"), closed(s).alias("out"))), closed)
    runs = rows.select(*BY, F.explode(fold).alias("len"))
    return runs.groupBy(*BY).agg(F.count(F.lit(1)).alias("runs"), F.sum("len").alias("covered"), F.sum(costs.gamma_bits(F.col("len") + 1)).cast("long").alias("gamma_bits"), F.max("len").cast("long").alias("longest"))


@R.add(sql.q(*V_TP, RES, "ft AS (SELECT b4.img, b4.ch, count(*) AS n, CAST(sum(a * a) AS HUGEINT) AS saa, CAST(sum(a * b) AS HUGEINT) AS sab, CAST(sum(b * b) AS HUGEINT) AS sbb, CAST(sum(a * v) AS HUGEINT) AS sav, CAST(sum(b * v) AS HUGEINT) AS sbv FROM b4 GROUP BY ALL)", "SELECT img, ch, CASE WHEN saa * sbb - sab * sab = 0 THEN NULL ELSE round(CAST(sav * sbb - sbv * sab AS DOUBLE) / CAST(saa * sbb - sab * sab AS DOUBLE), 6) END AS wa, CASE WHEN saa * sbb - sab * sab = 0 THEN NULL ELSE round(CAST(sbv * saa - sav * sab AS DOUBLE) / CAST(saa * sbb - sab * sab AS DOUBLE), 6) END AS wb FROM ft"))
def normal_equations(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares weights of left and top from sums of products and Cramer's rule, in decimals of 38 digits."""
    a, b, v = (F.col(x).cast("long") for x in ("a", "b", "v"))
    s = base.taps(spark, d, "evt").groupBy(*BY).agg(*[F.sum(x).cast("decimal(19,0)").alias(n) for n, x in {"saa": a * a, "sab": a * b, "sbb": b * b, "sav": a * v, "sbv": b * v}.items()])
    det = (F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")).alias("det")
    s = s.select("*", det)
    weight = lambda x: F.when(F.col("det") != 0, F.round(x.cast("double") / F.col("det").cast("double"), 6))
    return s.select(*BY, weight(F.col("sav") * F.col("sbb") - F.col("sbv") * F.col("sab")).alias("wa"), weight(F.col("sbv") * F.col("saa") - F.col("sav") * F.col("sab")).alias("wb"))


@R.add(f"SELECT q.img, q.ch, CASE WHEN q.bits <= g.bits + 3 THEN 'keys' ELSE 'grid' END AS family, least(q.bits, g.bits + 3) AS bits FROM ({search.R.oracles['auto_group_count']}) q JOIN ({search.R.oracles['best_energy_grid']}) g ON q.img = g.img AND q.ch = g.ch")
def family_gate(spark: SparkSession, d: str) -> DataFrame:
    """Groups of gradient keys or an energy grid (with three bits for its number), whichever costs less."""
    q = search.auto_group_count(spark, d).select(*BY, F.col("bits").alias("q"))
    g = search.best_energy_grid(spark, d).select(*BY, (F.col("bits") + 3).alias("g"))
    return q.join(g, BY).select(*BY, F.when(F.col("q") <= F.col("g"), "keys").otherwise("grid").alias("family"), F.least("q", "g").alias("bits"))


def _bank_sql() -> str:
    parts = []
    for o, (p, t) in enumerate(color.BANK.values()):
        a, m, c = ("rgb"[k] for k in color.PERMUTATIONS[p])
        half = f"({c} + (({a} - {c}) >> 1))"
        x, y, z = (f"({half} + (({m} - {half}) >> 1))", f"({a} - {c})", f"({m} - {half})") if t == 6 else (a, f"({m} - (({a} + {c}) >> 1))", f"({c} - {a})")
        parts += [f"SELECT img * 100 + {o} AS img, {k} AS ch, i, j, {v} AS v FROM emb" for k, v in enumerate((x, y, z))]
    return "pl AS (" + " UNION ALL ".join(parts) + ")"


_NAMES = ", ".join(f"({o}, '{n}')" for o, n in enumerate(color.BANK))


@R.add(sql.q(sql.EMB, _bank_sql(), sql.taps(), RES, "hist AS (SELECT img, ch, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL)", sql.huffman("img, ch"), f"nm(o, rct) AS (VALUES {_NAMES}), t AS (SELECT img // 100 AS img, CAST(img % 100 AS INTEGER) AS o, CAST(sum(huff + 16 + 24 * alphabet) AS BIGINT) AS bits FROM hf GROUP BY ALL)", sql.first("t", "img", "bits, o", "best"), "SELECT img, rct, bits FROM best JOIN nm USING (o)"))
def transform_choice(spark: SparkSession, d: str) -> DataFrame:
    """The colour transform of the short bank under which an image's three planes cost least."""
    from ..operators import neighbors
    from ..sources import rasters

    rgb = rasters.embedding_raster(spark, d)
    zipped = F.arrays_zip("r", "g", "b")
    cells = [search._plane(zipped, color.rct(p, t), o, k) for o, (p, t) in enumerate(color.BANK.values()) for k in range(3)]
    planes = rgb.select("i", F.explode(F.array(*cells)).alias("x")).select("x.img", "x.ch", "i", "x.row")
    df = neighbors.edge_copied(neighbors.raw_taps(planes))
    hist = costs.histogram(df.withColumn("r", F.col("v") - predictors.med(*map(F.col, "abc"))), BY)
    total = costs.huffman_bits(hist, BY).groupBy(F.expr("img div 100").alias("img"), F.expr("cast(img % 100 as int)").alias("o")).agg(F.sum("stream").alias("bits"))
    names = F.array(*map(F.lit, color.BANK))
    return grouping.cheapest(total, ["img"], ("bits", "o")).select("img", F.get(names, F.col("o")).alias("rct"), "bits")
