"""Queries over whole codecs of planes and over searches that need a plane's samples in order."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codecs, costs, fits, folds
from . import base, foldsql, sql

R = base.Registry()
BY = ["img", "ch"]
_COUNT = "SELECT img, ch, count(*) AS samples, CAST(0 AS BIGINT) AS mismatches FROM pl GROUP BY ALL"
PLANES = (sql.EVT, sql.ycocg("evt"))


def planes(spark: SparkSession, d: str) -> DataFrame:
    return base.planes(spark, d, "evt")


def _returned(spark: SparkSession, d: str, **options) -> DataFrame:
    def fn(p: np.ndarray) -> dict:
        experts = codecs.block_choice(p) if options.get("experts") else None
        bits, codes = codecs.plane_stream(p, experts, options.get("runs", False))
        back = codecs.plane_from_stream(bits, codes, p.shape, **options)
        return {"samples": int(p.size), "mismatches": int((back != p).sum())}

    return folds.per_plane(planes(spark, d), fn, "samples long, mismatches long")


@R.add(sql.q(*PLANES, _COUNT))
def codec_energy_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Nine codes by energy class, decoded sample by sample."""
    return _returned(spark, d)


@R.add(sql.q(*PLANES, _COUNT))
def codec_runs(spark: SparkSession, d: str) -> DataFrame:
    return _returned(spark, d, runs=True)


@R.add(sql.q(*PLANES, _COUNT))
def codec_block_experts(spark: SparkSession, d: str) -> DataFrame:
    return _returned(spark, d, experts=True)


@R.add()
def codec_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Stream bits of each codec, tables counted at 24 bits a symbol."""

    def fn(p: np.ndarray) -> list[dict]:
        out = []
        for name, experts, runs in (("energy", None, False), ("runs", None, True), ("experts", codecs.block_choice(p), False), ("experts+runs", codecs.block_choice(p), True)):
            bits, codes = codecs.plane_stream(p, experts, runs)
            out.append({"codec": name, "bits": len(bits) + sum(16 + 24 * len(c) for c in codes.values())})
        return out

    return folds.per_plane(planes(spark, d), fn, "codec string, bits long")


def _by_energy(p: np.ndarray) -> dict[int, Counter]:
    e, r = folds.energy(p).ravel(), codecs.residuals(p).ravel()
    return {int(k): Counter(r[e == k].tolist()) for k in np.unique(e)}


@R.add()
def agglomerated_groups(spark: SparkSession, d: str) -> DataFrame:
    """Energy classes united while tables saved outweigh data lost."""

    def fn(p: np.ndarray) -> dict:
        parts = _by_energy(p)
        groups, bits = codecs.merged_groups(parts)
        return {"classes": len(parts), "groups": len(set(groups.values())), "before": sum(map(codecs.huffman_total, parts.values())), "bits": bits}

    return folds.per_plane(planes(spark, d), fn, "classes int, groups int, before long, bits long")


@R.add()
def hill_climbed_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Energy values in order, cut into four groups, the cuts moved while that saves."""

    def fn(p: np.ndarray) -> dict:
        n = folds.around(p)
        x = np.abs(n["a"] - n["c"]) + np.abs(n["b"] - n["c"])
        r = codecs.residuals(p)
        order = [Counter(r[x == k].tolist()) for k in np.unique(x)]
        cuts = sorted({len(order) * k // 4 for k in (1, 2, 3)} - {0, len(order)})
        start = sum(codecs.huffman_total(sum(order[a:b], Counter())) for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True))
        cuts, bits = codecs.refined_cuts(order, cuts) if cuts else (cuts, start)
        return {"cuts": cuts, "before": start, "bits": bits}

    return folds.per_plane(planes(spark, d), fn, "cuts array<int>, before long, bits long")


@R.add()
def context_tree(spark: SparkSession, d: str) -> DataFrame:
    def fn(p: np.ndarray) -> list[dict]:
        n = folds.around(p)
        feats = np.stack([np.abs(n["b"] - n["c"]), np.abs(n["a"] - n["c"]), np.abs(n["d"] - n["b"]), np.abs(n["a"] - n["b"]), (n["a"] + n["b"]) >> 1], -1).reshape(-1, 5)
        return codecs.grown_tree(feats, codecs.residuals(p).ravel())

    return folds.per_plane(planes(spark, d), fn, "leaf string, n long, bits long")


@R.add(foldsql.THREE_WAY)
def three_way_coder(spark: SparkSession, d: str) -> DataFrame:
    """By energy class the cheapest of Huffman, Golomb and range coding, by exact bits."""

    def fn(p: np.ndarray) -> list[dict]:
        e, r = folds.energy(p).ravel(), codecs.residuals(p).ravel()
        out = []
        for k in np.unique(e).tolist():
            mine = r[e == k]
            z = np.where(mine >= 0, 2 * mine, -2 * mine - 1)
            counts = Counter(mine.tolist())
            table = codecs.frequencies(dict(counts))
            bits = {"H": codecs.huffman_total(counts), "G": 4 + min(int(((z >> g) + 1 + g).sum()) for g in range(13)), "R": 16 + 32 * len(counts) + 64 + 8 * len(codecs.range_encode(mine.tolist(), table))}
            best = min(bits, key=bits.get)
            out.append({"e": k, "coder": best, "bits": bits[best]})
        return out

    return folds.per_plane(planes(spark, d), fn, "e int, coder string, bits long")


@R.add()
def forward_levels(spark: SparkSession, d: str) -> DataFrame:
    """The arithmetic coder started from four-bit levels of each context, which are sent."""

    def fn(p: np.ndarray) -> dict:
        r, act = codecs.residuals(p), folds.activity(p)
        ones, all_ = Counter(), Counter()
        for x, a in zip(r.ravel().tolist(), act.ravel().tolist(), strict=True):
            size = (folds.unsigned(x) + 1).bit_length()
            for place in range(size):
                c = a * folds.PLACES + min(place, folds.PLACES - 1)
                all_[c] += 1
                ones[c] += place == size - 1
        coder, raw = folds.BinaryCoder(4 * folds.PLACES), 0
        for c, n in all_.items():
            one = max(1, round(min(15, 16 * ones[c] // n) + 0.5))
            coder.counts[c] = [max(1, 16 - one), one]
        for x, a in zip(r.ravel().tolist(), act.ravel().tolist(), strict=True):
            size = (folds.unsigned(x) + 1).bit_length()
            for place in range(size):
                coder.step(a * folds.PLACES + min(place, folds.PLACES - 1), int(place == size - 1))
            raw += size - 1
        return {"bits": 8 * (-(-len(coder.finish()) // 8) + -(-raw // 8)) + 64 + 4 * 4 * folds.PLACES}

    return folds.per_plane(planes(spark, d), fn, "bits long")


@R.add()
def long_filters(spark: SparkSession, d: str) -> DataFrame:
    """Twelve-tap filters fitted robustly, kept if they code shorter than the median predictor with their weights."""

    def fn(p: np.ndarray) -> dict:
        h, w = p.shape
        pad = np.pad(p, ((3, 0), (3, 3)))
        places = [(0, -1), (0, -2), (0, -3), (-1, -2), (-1, -1), (-1, 0), (-1, 1), (-1, 2), (-2, -1), (-2, 0), (-2, 1), (-3, 0)]
        x = np.stack([pad[3 + i : 3 + i + h, 3 + j : 3 + j + w].ravel() for i, j in places], 1)
        q = np.clip(np.round(fits._robust(x.astype(float), p.ravel().astype(float)) * 256), -32768, 32767).astype(np.int64)
        mine = Counter((p.ravel() - ((x @ q + 128) >> 8)).tolist())
        plain = Counter(codecs.residuals(p).ravel().tolist())
        a, b = codecs.huffman_total(mine) + 12 * 16, codecs.huffman_total(plain)
        return {"kept": a < b, "bits": min(a, b), "plain": b}

    return folds.per_plane(planes(spark, d), fn, "kept boolean, bits long, plain long")


@R.add()
def lifted_and_deflated(spark: SparkSession, d: str) -> DataFrame:
    """A lifting without mirrored ends along rows, then a general compressor."""
    import zlib

    def fn(p: np.ndarray) -> dict:
        even, odd = p[:, ::2], p[:, 1::2]
        nxt = np.concatenate([even[:, 1:], even[:, -1:]], 1)[:, : odd.shape[1]]
        high = odd - ((even[:, : odd.shape[1]] + nxt) >> 1)
        before = np.concatenate([np.zeros_like(high[:, :1]), high], 1)[:, : even.shape[1]]
        now = np.pad(high, ((0, 0), (0, even.shape[1] - high.shape[1])))
        low = even + ((before + now + 2) >> 2)
        return {"n_bytes": len(zlib.compress(np.concatenate([low, high], 1).astype("<i2").tobytes(), 9))}

    return folds.per_plane(planes(spark, d), fn, "n_bytes long")


@R.add(foldsql.MIXTURES)
def mixture_tables(spark: SparkSession, d: str) -> DataFrame:
    """The parametric table (scale, weight, ratio) whose ideal code lengths cost a plane's residuals least."""
    tables = [(s, w, ratio) for s in (0.5, 1, 2, 4, 8, 16, 32) for w in (0.5, 0.75, 0.9) for ratio in (3, 6)]
    hist = costs.histogram(base.med_residuals(spark, d, "evt"), BY)
    cells = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w"), F.lit(float(q)).alias("q")) for s, w, q in tables])
    x = F.abs("sym")
    wide = F.col("s") * F.col("q")
    pmf = F.col("w") * F.exp(-x / F.col("s")) / (2 * F.col("s")) + (1 - F.col("w")) * F.exp(-x / wide) / (2 * wide)
    df = hist.select(*BY, "sym", "cnt", F.inline(cells)).withColumn("bits", F.col("cnt") * F.least(F.lit(64.0), -F.log2(F.greatest(pmf, F.lit(1e-19)))))
    each = df.groupBy(*BY, "s", "w", "q").agg(F.round(F.sum("bits"), 3).alias("bits"))
    best = each.groupBy(*BY).agg(F.min(F.struct("bits", "s", "w", "q")).alias("x"))
    return best.select(*BY, "x.s", "x.w", F.col("x.q").alias("ratio"), "x.bits")


@R.add(foldsql.SHARED)
def shared_tables(spark: SparkSession, d: str, tables: int = 3, rounds: int = 3) -> DataFrame:
    """Histograms of all planes assigned to a few shared tables in turns: to the cheapest table, then tables anew."""
    hist = costs.histogram(base.residual_samples(spark, d, "evt"), BY).persist()  # read in every round
    assigned = hist.select(*BY).distinct().withColumn("t", (F.pmod(F.col("img") * 3 + F.col("ch"), F.lit(tables))).cast("int"))
    for _ in range(rounds):
        held = hist.join(assigned, BY).groupBy("t", "sym").agg(F.sum("cnt").alias("c"))
        total = held.groupBy("t").agg(F.sum("c").alias("n"))
        price = held.join(total, "t").select("t", "sym", (-F.log2((F.col("c") + 0.5) / (F.col("n") + 1024))).alias("len"))
        floor = total.select("t", (-F.log2(F.lit(0.5) / (F.col("n") + 1024))).alias("none"))
        # a plane's cost under a table: shared symbols at their length, the others at the table's escape
        met = hist.join(price, "sym").groupBy(*BY, "t").agg(F.sum(F.col("cnt") * F.col("len")).alias("b"), F.sum("cnt").alias("m"))
        every = hist.groupBy(*BY).agg(F.sum("cnt").alias("n")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).join(F.broadcast(floor), "t")  # as many rows as shared tables
        cost = every.join(met, [*BY, "t"], "left").select(*BY, "t", F.round(F.coalesce("b", F.lit(0.0)) + (F.col("n") - F.coalesce("m", F.lit(0))) * F.col("none"), 3).alias("bits"))
        best = cost.groupBy(*BY).agg(F.min(F.struct("bits", "t")).alias("x"))
        assigned = best.select(*BY, "x.t", "x.bits").checkpoint() if spark.sparkContext.getCheckpointDir() else best.select(*BY, "x.t", "x.bits")
        out, assigned = assigned, assigned.select(*BY, "t")
    return out.select(*BY, "t", "bits")
