"""Queries whose state runs along the raster: adaptive coders, predictors that learn, bit streams and small fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import codecs, costs, fits, folds
from ..sources import rasters
from . import base, foldsql, lengths, sql

R = base.Registry()
PLANES = (sql.EVT, sql.ycocg("evt"))


def planes(spark: SparkSession, d: str) -> DataFrame:
    return base.planes(spark, d, "evt")


@R.add(foldsql.GOLOMB_ACTIVITY)
def adaptive_golomb_activity(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive Golomb bits with one state an activity bin, and with a single state."""
    fn = lambda p: {"bits": folds.adaptive_golomb(codecs.residuals(p), folds.activity(p)), "single": folds.adaptive_golomb(codecs.residuals(p), np.zeros_like(p))}
    return folds.per_plane(planes(spark, d), fn, "bits long, single long")


@R.add(foldsql.GOLOMB_GROUPS)
def adaptive_golomb_groups(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive Golomb by energy group, and by group and activity together."""

    def fn(p: np.ndarray) -> dict:
        r, e = codecs.residuals(p), folds.energy(p)
        return {"by_group": folds.adaptive_golomb_groups(r, e), "joint": folds.adaptive_golomb(r, e * 4 + folds.activity(p))}

    return folds.per_plane(planes(spark, d), fn, "by_group long, joint long")


@R.add(foldsql.RUNS)
def adaptive_runs(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), lambda p: {"bits": folds.gated_runs(codecs.residuals(p), folds.activity(p))}, "bits long")


@R.add(sql.q(*PLANES, "SELECT img, ch, count(*) AS samples, CAST(0 AS BIGINT) AS mismatches FROM pl GROUP BY ALL"))
def arithmetic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Residuals through the binary arithmetic coder and back."""

    def fn(p: np.ndarray) -> dict:
        r, act = codecs.residuals(p), folds.activity(p)
        back = folds.arithmetic_decode(*folds.arithmetic_encode(r, act), act)
        return {"samples": int(r.size), "mismatches": int((back != r).sum())}

    return folds.per_plane(planes(spark, d), fn, "samples long, mismatches long")


@R.add()
def arithmetic_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of coded prefixes and raw suffixes, and the total with two 32-bit lengths."""

    def fn(p: np.ndarray) -> dict:
        coded, raw = (-(-len(x) // 8) for x in folds.arithmetic_encode(codecs.residuals(p), folds.activity(p)))
        return {"coded": coded, "raw": raw, "bits": 8 * (coded + raw) + 64}

    return folds.per_plane(planes(spark, d), fn, "coded long, raw long, bits long")


@R.add()
def complete_loco(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), folds.loco, "regular long, unbiased long, run_bits long, runs long, interruptions long")


@R.add(foldsql.SIGN_LMS)
def sign_lms_error(spark: SparkSession, d: str) -> DataFrame:
    fn = lambda p: {f"l1_{t}": int(np.abs(p - folds.sign_lms(p, t)).sum()) for t in (0, 3)}
    return folds.per_plane(planes(spark, d), fn, "l1_0 long, l1_3 long")


@R.add(foldsql.MAGNITUDE_LMS)
def magnitude_lms_error(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), lambda p: {"l1": int(np.abs(folds.magnitude_lms(p)).sum())}, "l1 long")


@R.add(foldsql.MIXED)
def mixed_predictors(spark: SparkSession, d: str) -> DataFrame:
    """The median predictor and the plain average, whichever did better lately."""

    def fn(p: np.ndarray) -> dict:
        n = folds.around(p)
        return {"l1": int(np.abs(folds.mixed(p, folds.med(n["a"], n["b"], n["c"]), (n["a"] + n["b"]) >> 1)).sum())}

    return folds.per_plane(planes(spark, d), fn, "l1 long")


@R.add(foldsql.CLOSED_LOOP)
def near_lossless_closed_loop(spark: SparkSession, d: str) -> DataFrame:
    """Prediction from reconstructed samples keeps every error within tau: the largest, their sum, and the symbols' magnitudes."""

    def fn(p: np.ndarray) -> list[dict]:
        out = []
        for t in range(3):
            symbols, back = folds.closed_loop(p, t)
            out.append({"tau": t, "max_error": int(np.abs(p - back).max()), "l1": int(np.abs(p - back).sum()), "symbols": int(np.abs(symbols).sum())})
        return out

    return folds.per_plane(planes(spark, d), fn, "tau int, max_error long, l1 long, symbols long")


@R.add(foldsql.GAP_BIAS)
def gap_with_bias(spark: SparkSession, d: str) -> DataFrame:
    """Gradient-adjusted prediction corrected by the running mean error of nine energy classes."""

    def fn(p: np.ndarray) -> dict:
        n, e = folds.around(p), folds.energy(p)
        step = np.abs(n["a"] - n["c"]) + np.abs(n["b"] - n["nne"]) + np.abs(n["d"] - n["b"]) - np.abs(n["a"] - n["ww"]) - np.abs(n["b"] - n["c"]) - np.abs(n["b"] - n["d"])
        guess = np.where(step > 80, n["a"], np.where(step < -80, n["b"], ((n["a"] + n["b"]) >> 1) + ((n["d"] - n["c"]) >> 2)))
        sums, counts, total = [0] * 9, [0] * 9, 0
        for y, g, k in zip(p.ravel().tolist(), guess.ravel().tolist(), e.ravel().tolist(), strict=True):
            if counts[k] and sums[k] <= -counts[k]:
                g, sums[k] = g - 1, sums[k] + counts[k]
            elif counts[k] and sums[k] > 0:
                g, sums[k] = g + 1, sums[k] - counts[k]
            total += abs(y - g)
            sums[k], counts[k] = sums[k] + y - g, counts[k] + 1
            if counts[k] >= 64:
                sums[k], counts[k] = sums[k] // 2, counts[k] // 2
        return {"l1": total, "plain": int(np.abs(p - guess).sum())}

    return folds.per_plane(planes(spark, d), fn, "l1 long, plain long")


@R.add("SELECT doc_id, strlen(text) AS n_bytes, true AS equal FROM documents WHERE strlen(text) > 0")
def lz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts through the windowed matcher and back."""
    docs = rasters.table(spark, d, "documents").filter("octet_length(text) > 0").select("doc_id", "text")

    def run(batches):
        for b in batches:
            data = [x.encode() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([folds.lz_decode(folds.lz_encode(x)) == x for x in data])], names=["doc_id", "n_bytes", "equal"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, equal boolean")


@R.add()
def lz_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = rasters.table(spark, d, "documents").select("doc_id", "text")

    def run(batches):
        for b in batches:
            got = [folds.lz_encode((x or "").encode()) for x in b.column("text").to_pylist()]
            matches = [sum(1 for _, far in t if far) for t in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in got], pa.int64()), pa.array(matches, pa.int64())], names=["doc_id", "tokens", "matches"])

    return docs.mapInArrow(run, "doc_id long, tokens long, matches long")


_RES = f"rs AS (SELECT img, ch, v - {sql.med()} AS r FROM b4), hist AS (SELECT img, ch, r AS sym, count(*) AS cnt FROM rs GROUP BY ALL)"


@R.add(sql.q(*PLANES, sql.taps(), _RES, sql.huffman("img, ch"), "SELECT img, ch, CASE WHEN alphabet = 1 THEN n ELSE huff END AS payload_bits, alphabet, CAST(0 AS BIGINT) AS mismatches FROM hf"))
def huffman_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Residuals as canonical codes packed to bytes, unpacked and rebuilt to samples."""

    def fn(p: np.ndarray) -> dict:
        r = codecs.residuals(p)
        flat, sizes = codecs.designed(r)
        codes = codecs.canonical(sizes)
        data, n_bits = codecs.huffman_pack(flat, codes)
        back = codecs.rebuilt(np.array(codecs.huffman_unpack(data, n_bits, codes)).reshape(r.shape))
        return {"payload_bits": n_bits, "alphabet": len(codes), "mismatches": int((back != p).sum())}

    return folds.per_plane(planes(spark, d), fn, "payload_bits long, alphabet long, mismatches long")


@R.add(foldsql.CODES)
def canonical_code_tables(spark: SparkSession, d: str) -> DataFrame:
    """Canonical codes; lengths from a fold over counts, codes from running sums of Kraft shares."""
    hist = costs.histogram(base.med_residuals(spark, d, "evt"), ["img", "ch"]).groupBy("img", "ch").agg(F.collect_list(F.struct("sym", "cnt")).alias("h"))

    def run(batches):
        for b in batches:
            out = [(i, c, s, n) for i, c, h in zip(*(x.to_pylist() for x in b.columns), strict=True) for s, n in codecs.code_lengths({e["sym"]: e["cnt"] for e in h}).items()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["img", "ch", "sym", "len"])

    return costs.canonical_codes(hist.mapInArrow(run, "img long, ch int, sym int, len int"), ["img", "ch"])


@R.add(sql.q(*PLANES, "SELECT DISTINCT img, ch, CAST(1.0 AS DOUBLE) AS kraft FROM pl"))
def kraft_sums(spark: SparkSession, d: str) -> DataFrame:
    """A complete prefix code's shares sum to one."""
    return canonical_code_tables(spark, d).groupBy("img", "ch").agg(F.round(F.sum(F.pow(F.lit(2.0), -F.col("len"))) * F.when(F.count(F.lit(1)) == 1, 2.0).otherwise(1.0), 9).alias("kraft"))


@R.add(sql.q(*PLANES, sql.taps(), _RES, sql.golomb("img, ch"), sql.first("gk", "img, ch", "bits, k", "gb"), "SELECT img, ch, k, bits, CAST(0 AS BIGINT) AS mismatches FROM gb"))
def golomb_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Golomb codes in both polarities: lengths equal the cost, and all symbols return."""
    best = costs.golomb_best(lengths.med_histogram(spark, d, "evt"), ["img", "ch"])

    def fn(p: np.ndarray) -> list[dict]:
        r = codecs.residuals(p).ravel()
        z = np.where(r >= 0, 2 * r, -2 * r - 1).tolist()
        prices = [sum((v >> k) + 1 + k for v in z) for k in range(13)]
        k = prices.index(min(prices))
        bad = 0
        for ones in (False, True):
            bits = codecs.golomb_pack(z, k, ones)
            bad += int(codecs.golomb_unpack(bits, k, ones) != z) + int(len(bits) != prices[k])
        return [{"mismatches": bad}]

    return best.join(folds.per_plane(planes(spark, d), fn, "mismatches long"), ["img", "ch"])


@R.add(foldsql.RANGE)
def range_coder_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the range coder, its cost with tables, and mismatches after decoding (0)."""

    def fn(p: np.ndarray) -> dict:
        flat = codecs.residuals(p).ravel().tolist()
        values, counts = np.unique(flat, return_counts=True)
        table = codecs.frequencies(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        data = codecs.range_encode(flat, table)
        back = codecs.range_decode(data, len(flat), table)
        return {"n_bytes": len(data), "bits": 16 + 32 * len(table) + 64 + 8 * len(data), "mismatches": sum(x != y for x, y in zip(flat, back, strict=True))}

    return folds.per_plane(planes(spark, d), fn, "n_bytes long, bits long, mismatches long")


@R.add(sql.q(sql.EVT, "SELECT img, count(*) AS pixels, CAST(0 AS BIGINT) AS mismatches FROM evt GROUP BY img"))
def codec_order0(spark: SparkSession, d: str) -> DataFrame:
    """The whole codec: colour transform, residuals, canonical codes as bytes; decoded to pixels and compared."""
    rgb = rasters.event_raster(spark, d)
    coded = folds.per_plane(base.planes(spark, d, "evt"), codecs.encode_plane, "height int, width int, table binary, payload binary, payload_bits long")
    plane = coded.mapInArrow(codecs.decode_planes, "img long, ch int, i int, row array<int>")
    wide = plane.groupBy("img", "i").agg(*[F.max(F.when(F.col("ch") == k, F.col("row"))).alias(n) for k, n in enumerate(("y", "co", "cg"))])
    px = wide.select("img", "i", F.posexplode(F.arrays_zip("y", "co", "cg")).alias("j", "p")).select("img", "i", "j", "p.*")
    back = px.select("img", "i", "j", F.struct(*[x.alias(c) for c, x in zip("rgb", color.ycocg_inverse(*map(F.col, ("y", "co", "cg"))), strict=True)]).alias("back"))
    both = rasters.pixels(rgb).select("img", "i", "j", F.struct("r", "g", "b").alias("rgb")).join(back, ["img", "i", "j"], "full")
    return both.groupBy("img").agg(F.count("rgb").alias("pixels"), F.count_if(~F.col("rgb").eqNullSafe(F.col("back"))).alias("mismatches"))


@R.add()
def zlib_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of residuals as 16-bit zigzag values under a general compressor."""
    import zlib

    fn = lambda p: {"n_bytes": len(zlib.compress(folds.unsigned(codecs.residuals(p)).astype("<u2").tobytes(), 9))}
    return folds.per_plane(planes(spark, d), fn, "n_bytes long")


@R.add()
def fitted_energy_predictors(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), fits.energy_predictors, "e int, n long, fitted boolean, weights array<long>, l1_med long, l1 long")


@R.add()
def fitted_block_averages(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), fits.block_averages, "block int, kept boolean, weights array<long>, l1 long")


@R.add()
def fitted_linear_blocks(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), fits.linear_blocks, "block int, kept boolean, weights array<long>, mean_error double")


@R.add()
def fitted_small_nets(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), fits.small_net, "bin int, n long, scale int, params int, med_bits double, net_bits double, kept boolean, channel boolean")


@R.add()
def late_averaged_nets(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), fits.late_averages, "bin int, final_bits double, averaged_bits double, averaged boolean")


@R.add()
def global_nets(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_plane(planes(spark, d), fits.global_net, "scale int, params int, med_bits double, net_bits double, kept boolean")


@R.add()
def cross_channel_fits(spark: SparkSession, d: str) -> DataFrame:
    return folds.per_image(planes(spark, d), fits.cross_channel, "ch int, med_bits double, alone_bits double, joint_bits double")


@R.add(foldsql.SIMILARITY)
def structural_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of planes to themselves rounded to multiples of 5: Gaussian windows of deviation 1.5, mirrored borders."""
    kernel = np.exp(-(np.arange(-6, 7) ** 2) / (2 * 1.5**2))
    kernel /= kernel.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(x, [(6, 6) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
            x = sum(w * np.take(padded, range(k, k + x.shape[axis]), axis) for k, w in enumerate(kernel))
        return x

    def fn(p: np.ndarray) -> dict:
        x = p.astype(float)
        y = np.clip(np.round(x / 5) * 5, 0, 255)
        mx, my = smooth(x), smooth(y)
        vx, vy, vxy = smooth(x * x) - mx * mx, smooth(y * y) - my * my, smooth(x * y) - mx * my
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        s = (2 * mx * my + c1) * (2 * vxy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
        return {"ssim": round(float(s.mean()), 6)}

    plain = rasters.planes(rasters.event_raster(spark, d))
    return folds.per_plane(plain, fn, "ssim double").groupBy("img").agg(F.round(F.avg("ssim"), 6).alias("ssim"))
