"""Hand-checked cases and properties of the building blocks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.operators import codecs, costs, fits, folds
from pixelmill.plans.reports import wilcoxon


def test_huffman_hand_case(spark):
    df = spark.createDataFrame([("x", s, n) for s, n in enumerate([5, 1, 1, 2, 7])] + [("y", 0, 9)], "g string, sym int, cnt long")
    got = {r.g: r.huff for r in costs.huffman_bits(df, ["g"]).collect()}
    assert got == {"x": 31, "y": 9}


def test_floor_and_zigzag(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in (-7, -1, 0, 1, 7)], "x int").select(color.half(x).alias("h"), color.floor_div(x, 3).alias("t"), color.zigzag(x).alias("z"), color.zigzag_up(x).alias("u")).collect()
    assert [r.h for r in rows] == [-4, -1, 0, 0, 3]
    assert [r.t for r in rows] == [-3, -1, 0, 0, 2]
    assert [r.z for r in rows] == [13, 1, 0, 2, 14]
    assert [r.u for r in rows] == [14, 2, 0, 1, 13]


def test_ycocg_hand_case(spark):
    y, co, cg = color.ycocg(F.lit(255), F.lit(0), F.lit(255))
    assert tuple(spark.range(1).select(y.alias("y"), co.alias("co"), cg.alias("cg")).first()) == (127, 0, -255)


def test_wilcoxon_all_one_sign(spark):
    r = wilcoxon(spark.createDataFrame([(k, 0) for k in range(1, 8)], "x long, y long")).first()
    assert (r.n, r.p) == (7, 2 / 128)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=200))
def test_symbol_coders_return(values):
    counts = dict(zip(*[x.tolist() for x in np.unique(values, return_counts=True)], strict=True))
    codes = codecs.canonical(codecs.code_lengths(counts))
    assert sum(2.0 ** -n for _, n in codes.values()) == (1 if len(codes) > 1 else 0.5)
    assert codecs.huffman_unpack(*codecs.huffman_pack(values, codes), codes) == values
    table = codecs.frequencies(counts)
    assert sum(f for f, _ in table.values()) == 1 << 14
    assert codecs.range_decode(codecs.range_encode(values, table), len(values), table) == values
    up = [2 * v if v >= 0 else -2 * v - 1 for v in values]
    for k in (0, 3):
        for ones in (False, True):
            assert codecs.golomb_unpack(codecs.golomb_pack(up, k, ones), k, ones) == up


@pytest.mark.parametrize("n", [694, 1000, 16384])
def test_rare_symbols_rounded_up_leave_a_frequency_to_all(n):
    values = list(range(n)) * (2 if n == 1000 else 1) + [5]
    table = codecs.frequencies({s: values.count(s) for s in range(n)} if n < 2000 else dict.fromkeys(range(n), 1))
    assert min(f for f, _ in table.values()) >= 1 and sum(f for f, _ in table.values()) == 1 << 14
    assert codecs.range_decode(codecs.range_encode(values, table), len(values), table) == values
    with pytest.raises(ValueError):
        codecs.frequencies(dict.fromkeys(range((1 << 14) + 1), 1))


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (6, 1), (9, 12)])
def test_planes_return(shape):
    rng = np.random.default_rng(3)
    for p in (rng.integers(0, 256, shape), np.full(shape, 7), rng.integers(0, 3, shape)):
        p = p.astype(np.int64)
        r, act = codecs.residuals(p), folds.activity(p)
        assert (codecs.rebuilt(r) == p).all()
        assert (folds.arithmetic_decode(*folds.arithmetic_encode(r, act), act) == r).all()
        assert np.abs(p - folds.closed_loop(p, 2)[1]).max() <= 2
        assert (folds.closed_loop(p, 0)[1] == p).all()
        assert folds.loco(p)["regular"] >= 0


def test_lz_returns():
    random.seed(4)
    for text in (b"", b"a", b"abcabcabcabc" * 40, bytes(random.choice(b"ab") for _ in range(3000)), b"x" * 6000):
        assert folds.lz_decode(folds.lz_encode(text)) == text


def test_adaptive_rate_is_least_sufficient():
    for total in range(1, 40):
        for count in range(1, 9):
            k = 0
            while count << k < total:
                k += 1
            assert folds.Rate(total, count).price(0, 0) == 1 + k


def test_weight_scale():
    assert fits.weight_scale(np.array([1.0])) == 4096
    assert fits.weight_scale(np.array([100.0])) == 256


def low_complexity_bits(plane):
    """The complete low-complexity coder in plain loops, without what the operator shares."""
    h, w = len(plane), len(plane[0])
    at = lambda i, j: plane[max(0, i)][min(w - 1, max(0, j))]
    level = lambda g: (g > 0) - (g < 0) if abs(g) < 3 else (2 if abs(g) < 8 else 3 if abs(g) < 22 else 4) * (1 if g > 0 else -1)

    def price(state, e):
        k = 0
        while state["N"] << k < state["A"]:
            k += 1
        m = 2 * e if e >= 0 else -2 * e - 1
        state["A"] += abs(e)
        state["N"] += 1
        if state["N"] == 64:
            state["A"], state["N"] = state["A"] // 2, 32
        return (m >> k) + 1 + k

    fresh = lambda: {"A": 4, "N": 1}
    rates, plain, bias, run = {}, {}, {}, fresh()
    out = {"regular": 0, "unbiased": 0, "run_bits": 0, "runs": 0, "interruptions": 0}
    lo, hi = min(map(min, plane)), max(map(max, plane))
    for i in range(h):
        j = 0
        while j < w:
            a = plane[i][j - 1] if j else plane[i][0]
            b, c, d = at(i - 1, j), at(i - 1, j - 1) if i else (plane[0][max(0, j - 1)]), at(i - 1, j + 1)
            if a == b == c == d:
                n = 0
                while j + n < w and plane[i][j + n] == a:
                    n += 1
                out["runs"] += 1
                out["run_bits"] += 2 * ((n + 1).bit_length() - 1) + 1
                if j + n < w:
                    out["run_bits"] += price(run, plane[i][j + n] - a)
                    out["interruptions"] += 1
                j += n + 1
                continue
            q = [level(b - c), level(c - a), level(d - b)]
            sign = -1 if next((x for x in q if x), 1) < 0 else 1
            key = tuple(sign * x for x in q)
            guess = sorted((a, b, a + b - c))[1]
            state = bias.setdefault(key, {"B": 0, "C": 0, "N": 1})
            better = min(hi, max(lo, guess + sign * state["C"]))
            e = sign * (plane[i][j] - better)
            out["regular"] += price(rates.setdefault(key, fresh()), e)
            out["unbiased"] += price(plain.setdefault(key, fresh()), sign * (plane[i][j] - guess))
            state["B"], state["N"] = state["B"] + e, state["N"] + 1
            if state["B"] <= -state["N"]:
                state["B"] += state["N"]
                state["C"] -= state["C"] > -4
                state["B"] = max(state["B"], 1 - state["N"])
            elif state["B"] > 0:
                state["B"] -= state["N"]
                state["C"] += state["C"] < 4
                state["B"] = min(state["B"], 0)
            if state["N"] == 64:
                state["B"], state["N"] = int(state["B"] / 2), 32
            j += 1
    return out


def test_complete_low_complexity_coder():
    rng = np.random.default_rng(4)
    noise = rng.integers(-40, 200, (40, 33))
    drift = np.cumsum(rng.integers(-2, 4, (48, 48)), 1) // 2
    flat = np.kron(rng.integers(0, 5, (8, 8)) * 30, np.ones((6, 6), np.int64)) + (rng.random((48, 48)) < 0.02) * 9
    for plane in (noise, drift, flat, np.zeros((3, 5), np.int64)):
        assert folds.loco(plane) == low_complexity_bits(plane.tolist())


def test_nets():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (900, 5))
    y = x @ np.array([0.5, -0.2, 0.1, 0, 0.3]) + 0.1
    start = fits.net_start(x, y, 8)
    assert np.abs(fits.net_value(x, start) - y).mean() < 0.02  # near the linear fit
    curved = np.tanh(3 * y)
    net, mean = fits.trained_net(x, curved, rounds=300, rate=0.01, late=250)
    assert np.abs(fits.net_value(x, net) - curved).mean() < 0.9 * np.abs(fits.net_value(x, fits.net_start(x, curved, 8)) - curved).mean()
    assert np.abs(fits.net_value(x, mean) - fits.net_value(x, net)).max() < 0.05
    u = np.tanh(x @ net[0] + net[1])
    assert np.allclose(fits.net_value(x, net), u @ net[2] + net[3])
    sent, scale = fits.sent_net(net)
    assert all(np.array_equal(np.round(p * scale), p * scale) and np.abs(p * scale).max() <= 32767 for p in sent)
    assert fits.entropy_bits(np.array([1, 1, 2, 2])) == 4 and fits.entropy_bits(np.array([7, 7])) == 0


def test_cross_channel_fits():
    rng = np.random.default_rng(6)
    luma = np.cumsum(rng.integers(-9, 10, (40, 40)), 1)
    chroma = luma // 2 + rng.integers(0, 2, (40, 40))
    for r in fits.cross_channel({0: luma, 1: chroma, 2: rng.integers(0, 255, (40, 40))}):
        assert r["joint_bits"] < 0.8 * r["alone_bits"] if r["ch"] == 1 else r["joint_bits"] > 0.9 * r["alone_bits"]
