"""Small models fitted to a plane or a block of it."""

from __future__ import annotations

import math

import numpy as np

from .folds import around, corners_zero, med


def _robust(x: np.ndarray, y: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Weights of least absolute error, by reweighted least squares."""
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        s = 1 / np.sqrt(np.maximum(1.0, np.abs(x @ w - y)))
        w = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
    return w


def energy_predictors(plane: np.ndarray, least: int = 50) -> list[dict]:
    """By energy class: six weights (times 256, rounded) or, where too few samples or no gain, none; and the error with them."""
    n = around(plane)
    a, b, c = (n[k].ravel() for k in "abc")
    y = plane.ravel()
    e = np.minimum(8, (np.abs(a - c) + np.abs(b - c)) >> 4)
    x = np.stack([np.ones_like(a), a, b, c, np.abs(a - b), a + b - 2 * c], 1)
    plain = med(a, b, c)
    out = []
    for k in range(9):
        m = e == k
        if not m.any():
            continue
        weights, before = None, int(np.abs(y[m] - plain[m]).sum())
        after = before
        if m.sum() >= least:
            w = _robust(x[m].astype(float), y[m].astype(float))
            if np.abs(x[m] @ w - y[m]).mean() < np.abs(plain[m] - y[m]).mean():
                weights = np.clip(np.round(w * 256), -32768, 32767).astype(np.int64)
                after = int(np.abs(y[m] - ((x[m] @ weights + 128) >> 8)).sum())
        out.append({"e": k, "n": int(m.sum()), "fitted": weights is not None, "weights": None if weights is None else weights.tolist(), "l1_med": before, "l1": after})
    return out


def block_averages(plane: np.ndarray, size: int = 32) -> list[dict]:
    """By block: four weights (in sixteenths) of least squares on left, top and both corners, kept if they pay for 21 bits."""
    left, top, corner = corners_zero(plane)
    right = np.zeros_like(plane)
    right[1:, :-1] = plane[:-1, 1:]
    plain = plane - med(left, top, corner)
    out = []
    for bi in range(0, plane.shape[0], size):
        for bj in range(0, plane.shape[1], size):
            s = np.s_[bi : bi + size, bj : bj + size]
            x = np.stack([v[s].ravel() for v in (left, top, corner, right)], 1)
            y = plane[s].ravel()
            w = np.clip(np.round(16 * np.linalg.lstsq(x.astype(float), y.astype(float), rcond=None)[0]), -16, 15).astype(np.int64)
            r = y - ((x @ w + 8) >> 4)
            before, after = np.abs(plain[s]).mean() + 1e-9, np.abs(r).mean() + 1e-9
            kept = bool(w.any() and after < before and y.size * math.log2(before / after) > 21)
            out.append({"block": (bi // size) * -(-plane.shape[1] // size) + bj // size, "kept": kept, "weights": w.tolist(), "l1": int(np.abs(r).sum() if kept else np.abs(plain[s]).sum())})
    return out


def linear_blocks(plane: np.ndarray, size: int = 16) -> list[dict]:
    """By block: three weights (times 32) on left, top and corner, kept if they lower the mean error of a plain average by a tenth."""
    n = around(plane)
    out = []
    for bi in range(0, plane.shape[0], size):
        for bj in range(0, plane.shape[1], size):
            s = np.s_[bi : bi + size, bj : bj + size]
            x = np.stack([n[k][s].ravel() for k in "abc"], 1).astype(float)
            y = plane[s].ravel().astype(float)
            q = np.clip(np.round(32 * np.linalg.lstsq(x, y, rcond=None)[0]), -128, 127)
            mine, plain = np.abs(y - x @ q / 32).mean(), np.abs(y - (x[:, 0] + x[:, 1]) / 2).mean()
            out.append({"block": (bi // size) * -(-plane.shape[1] // size) + bj // size, "kept": bool(mine < 0.9 * plain), "weights": q.astype(int).tolist(), "mean_error": round(float(mine), 6)})
    return out


#: Scales of sixteen-bit weights (fixed values).
SCALES = (256, 512, 1024, 2048, 4096)


def weight_scale(weights: np.ndarray) -> int:
    """The largest scale at which no weight leaves sixteen bits (the smallest if all do)."""
    most = float(np.abs(weights).max()) if weights.size else 0.0
    return max([s for s in SCALES if most * s <= 32767], default=SCALES[0])


def entropy_bits(values: np.ndarray) -> float:
    """Bits of the values at their own entropy, rounded to thousandths."""
    n = np.unique(values, return_counts=True)[1]
    return round(float(values.size * math.log2(values.size) - (n * np.log2(n)).sum()), 3) if values.size else 0.0


Net = list[np.ndarray]  # weights and biases of the first and of the second layer


def net_start(x: np.ndarray, y: np.ndarray, hidden: int) -> Net:
    """A net that is near the linear least-squares fit: units that pass an input each, a tenth as large, and its weights ten times as large."""
    linear = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    through = min(hidden, x.shape[1])
    out = np.zeros(hidden)
    out[:through] = linear[:through] * 10
    return [np.eye(x.shape[1], hidden) / 10, np.zeros(hidden), out, linear[-1:].copy()]


def net_value(x: np.ndarray, net: Net) -> np.ndarray:
    """The net's output. Sums run over inputs and units one after another, so that the order of additions is fixed."""
    first, bias, second, last = net
    units = np.tile(bias, (len(x), 1))
    for k in range(x.shape[1]):
        units = units + x[:, k : k + 1] * first[k]
    units, total = np.tanh(units), np.full(len(x), last[0])
    for k in range(len(second)):
        total = total + units[:, k] * second[k]
    return total


def trained_net(x: np.ndarray, y: np.ndarray, hidden: int = 8, rounds: int = 200, rate: float = 0.003, batch: int = 16384, seed: int = 0, late: int | None = None) -> tuple[Net, Net]:
    """A tanh net fitted to absolute error: Adam from net_start() on random batches, steps that fall with half a cosine.

    The second net is the average of the states from round `late` on, ten rounds apart (the first if late is None)."""
    rng, net = np.random.default_rng(seed), net_start(x, y, hidden)
    mean, square, seen = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], []
    for t in range(rounds):
        pick = rng.permutation(len(x))[:batch]
        u = np.tanh(x[pick] @ net[0] + net[1])
        slope = np.sign(u @ net[2] + net[3] - y[pick]) / len(pick)
        back = slope[:, None] * net[2] * (1 - u * u)
        step = rate * (1 + math.cos(math.pi * t / rounds)) / 2
        for p, m, v, g in zip(net, mean, square, (x[pick].T @ back, back.sum(0), u.T @ slope, slope.sum(keepdims=True)), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= step * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
        if late is not None and t >= late and t % 10 == 0:
            seen.append([p.copy() for p in net])
    return net, [np.mean(ps, axis=0) for ps in zip(*seen, strict=True)] if seen else net


def sent_net(net: Net) -> tuple[Net, int]:
    """The net as its weights arrive: rounded at the largest scale that sixteen bits hold."""
    scale = weight_scale(np.concatenate([p.ravel() for p in net]))
    return [np.round(p * scale) / scale for p in net], scale


def _net_inputs(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ten causal taps (0 outside), the median prediction and 1; the median prediction; nine energy bins of equal weight."""
    n = around(plane)
    h, w = plane.shape
    pad = np.pad(plane, ((2, 0), (2, 2)))
    places = ((0, 1), (1, 0), (1, 1), (1, -1), (0, 2), (2, 0), (2, 1), (1, 2), (2, -1), (1, -2))  # rows up, columns to the left
    taps = [pad[2 - i : 2 - i + h, 2 - j : 2 - j + w] for i, j in places]
    plain = med(n["a"], n["b"], n["c"])
    energy = np.abs(taps[0] - taps[1]) + np.abs(taps[0] - taps[2]) + np.abs(taps[1] - taps[2])
    bins = np.searchsorted(np.quantile(energy, np.arange(1, 9) / 9), energy, "left")
    return np.stack([*taps, plain, np.ones_like(plane)], -1).reshape(-1, 12), plain.ravel(), bins.ravel()


def _net_bits(x: np.ndarray, y: np.ndarray, net: Net) -> float:
    return entropy_bits(y - np.floor(net_value(x / 128, net) * 128 + 0.5).astype(np.int64))


def small_net(plane: np.ndarray, least: int = 64) -> list[dict]:
    """By energy bin: a net of twelve inputs and eight units, kept if its bits and its weights (and four) are fewer than the median
    predictor's bits. channel: whether all kept nets together save more than 512 bits."""
    x, plain, bins = _net_inputs(plane)
    y, out = plane.ravel(), []
    for k in range(9):
        m = bins == k
        if m.sum() < least:
            continue
        net, scale = sent_net(trained_net(x[m] / 128, y[m] / 128, seed=k)[0])
        size = sum(p.size for p in net)
        before, after = entropy_bits(y[m] - plain[m]), _net_bits(x[m], y[m], net)
        out.append({"bin": k, "n": int(m.sum()), "scale": scale, "params": size, "med_bits": before, "net_bits": after, "kept": after + 16 * size + 4 < before})
    saved = sum(r["med_bits"] - r["net_bits"] - 16 * r["params"] - 4 for r in out if r["kept"])
    return [r | {"channel": saved > 512} for r in out]


def late_averages(plane: np.ndarray, least: int = 64) -> list[dict]:
    """The nets of the three busiest bins, and those averaged over their last rounds: bits of both."""
    x, _, bins = _net_inputs(plane)
    y, out = plane.ravel(), []
    for k in (6, 7, 8):
        m = bins == k
        if m.sum() >= least:
            final, mean = trained_net(x[m] / 128, y[m] / 128, rounds=300, seed=k, late=250)
            a, b = _net_bits(x[m], y[m], sent_net(final)[0]), _net_bits(x[m], y[m], sent_net(mean)[0])
            out.append({"bin": k, "final_bits": a, "averaged_bits": b, "averaged": b < a})
    return out


def global_net(plane: np.ndarray) -> dict:
    """One net of eight inputs for a whole plane, against the median predictor."""
    n = around(plane)
    plain = med(n["a"], n["b"], n["c"])
    x = np.stack([*(n[k] for k in ("a", "b", "c", "d", "ww", "nne")), plain, np.ones_like(plane)], -1).reshape(-1, 8)
    y = plane.ravel()
    net, scale = sent_net(trained_net(x / 128, y / 128, rounds=800, rate=0.01)[0])
    size = sum(p.size for p in net)
    before, after = entropy_bits(y - plain.ravel()), _net_bits(x, y, net)
    return {"scale": scale, "params": size, "med_bits": before, "net_bits": after, "kept": after + 16 * size < before}


def cross_channel(planes: dict[int, np.ndarray], least: int = 50) -> list[dict]:
    """For each chroma plane the bits of robust fits by energy class without and with the luma residual of the same place."""
    luma = around(planes[0])
    other = (planes[0] - med(luma["a"], luma["b"], luma["c"])).ravel()
    out = []
    for ch in (1, 2):
        n = around(planes[ch])
        a, b, c = (n[k].ravel() for k in "abc")
        y, plain = planes[ch].ravel(), med(a, b, c)
        e = np.minimum(8, (np.abs(a - c) + np.abs(b - c)) >> 4)
        own = np.stack([np.ones_like(a), a, b, c, np.abs(a - b), a + b - 2 * c], 1)
        left = {"alone": y - plain, "joint": y - plain}
        for name, x in (("alone", own), ("joint", np.column_stack([own, other]))):
            left[name] = left[name].copy()
            for k in np.unique(e).tolist():
                m = e == k
                if m.sum() >= least:
                    q = np.clip(np.round(_robust(x[m].astype(float), y[m].astype(float)) * 256), -32768, 32767).astype(np.int64)
                    left[name][m] = y[m] - ((x[m] @ q + 128) >> 8)
        out.append({"ch": ch, "med_bits": entropy_bits(y - plain), "alone_bits": entropy_bits(left["alone"]), "joint_bits": entropy_bits(left["joint"])})
    return out
