"""Coders and predictors whose state runs along the raster: grouped functions over one plane at a time.

A plane arrives as rows of samples, a few hundred bytes each, and is the unit that must fit one task; planes of
all images and channels run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def per_plane(planes: DataFrame, fn: Callable[[np.ndarray], dict | list[dict]], schema: str) -> DataFrame:
    """img, ch and the fields of schema: fn(plane) for every (img, ch) of planes (img, ch, i, row)."""
    whole = f"img long, ch int, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["i"]))
        rows = table["row"].to_pylist()
        plane = np.array([rows[k] for k in order], dtype=np.int64)
        got = fn(plane)
        out = [got] if isinstance(got, dict) else got
        img, ch = table["img"][0].as_py(), table["ch"][0].as_py()
        return pa.Table.from_pylist([{"img": img, "ch": ch} | x for x in out], arrow)

    return planes.groupBy("img", "ch").applyInArrow(run, whole)


def per_image(planes: DataFrame, fn: Callable[[dict[int, np.ndarray]], list[dict]], schema: str) -> DataFrame:
    """img and the fields of schema: fn({ch: plane}) for every image of planes (img, ch, i, row)."""
    whole = f"img long, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["ch"].to_pylist(), table["i"].to_pylist(), table["row"].to_pylist(), strict=True))
        got = fn({ch: np.array([r for c, _, r in rows if c == ch], dtype=np.int64) for ch in {c for c, _, _ in rows}})
        return pa.Table.from_pylist([{"img": table["img"][0].as_py()} | x for x in got], arrow)

    return planes.groupBy("img").applyInArrow(run, whole)


def around(plane: np.ndarray) -> dict[str, np.ndarray]:
    """Copied-border neighbours of every sample of a plane (the same as neighbors.edge_copied)."""
    h, w = plane.shape
    a, b, c, d = (np.zeros((h, w), np.int64) for _ in range(4))
    a[:, 1:], b[1:], c[1:, 1:], d[1:, :-1] = plane[:, :-1], plane[:-1], plane[:-1, :-1], plane[:-1, 1:]
    b[0, 1:] = c[0, 1:] = d[0, 1:] = plane[0, :-1]
    d[0, 0] = 0
    a[1:, 0] = c[1:, 0] = plane[:-1, 0]
    d[1:, -1] = plane[:-1, -1]
    ww, nne = a.copy(), b.copy()
    ww[:, 2:], nne[2:] = plane[:, :-2], plane[:-2]
    return {"a": a, "b": b, "c": c, "d": d, "ww": ww, "nne": nne}


def med(a, b, c):
    hi, lo = np.maximum(a, b), np.minimum(a, b)
    return np.where(c >= hi, lo, np.where(c <= lo, hi, a + b - c))


def corners_zero(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and top (each standing in for the other at an edge) and top left (0 outside)."""
    n = around(plane)
    c = np.zeros_like(plane)
    c[1:, 1:] = plane[:-1, :-1]
    return n["a"], n["b"], c


def unsigned(r):
    """0, 1, -1, 2, -2 ... as 0, 1, 2, 3, 4 ..."""
    return 2 * abs(r) - (r > 0)


class Rate:
    """A sum of magnitudes and a count that give a Golomb parameter, halved together now and then."""

    __slots__ = ("total", "count", "reset", "most")

    def __init__(self, total: int = 4, count: int = 1, reset: int = 64, most: int = 60):
        self.total, self.count, self.reset, self.most = total, count, reset, most

    def price(self, m: int, grow: int) -> int:
        """Bits of the symbol m; then the state learns a magnitude of `grow`."""
        k = min(self.most, (-(-self.total // self.count) - 1).bit_length()) if self.total > self.count else 0
        self.total += grow
        self.count += 1
        if self.count >= self.reset:
            self.count, self.total = max(1, self.count // 2), self.total // 2
        return (m >> k) + 1 + k


def adaptive_golomb(residuals: np.ndarray, contexts: np.ndarray) -> int:
    states: dict[int, Rate] = {}
    return sum(states.setdefault(c, Rate()).price(unsigned(r), abs(r)) for r, c in zip(residuals.ravel().tolist(), contexts.ravel().tolist(), strict=True))


def adaptive_golomb_groups(residuals: np.ndarray, groups: np.ndarray, most: int = 12) -> int:
    """The variant whose state counts symbols, not magnitudes, and starts at two of each."""
    states: dict[int, Rate] = {}
    total = 0
    for r, g in zip(residuals.ravel().tolist(), groups.ravel().tolist(), strict=True):
        m = unsigned(r)
        total += states.setdefault(g, Rate(2, 2, 1 << 60, most)).price(m, m)
    return total


def energy(plane: np.ndarray) -> np.ndarray:
    n = around(plane)
    return np.minimum(8, (np.abs(n["a"] - n["c"]) + np.abs(n["b"] - n["c"])) >> 4)


def activity(plane: np.ndarray) -> np.ndarray:
    left, top, corner = corners_zero(plane)
    return np.digitize(np.abs(left - corner) + np.abs(top - corner), (4, 12, 48))


def gated_runs(residuals: np.ndarray, act: np.ndarray) -> int:
    """Adaptive Golomb with runs of zeros wherever the activity is least; what ends a run is not zero."""
    r, a = residuals.ravel(), act.ravel()
    stops = np.append(np.flatnonzero(r), len(r))
    states, runs, total, i = [Rate() for _ in range(4)], Rate(), 0, 0
    while i < len(r):
        context = int(a[i])
        if context == 0:
            stop = int(stops[np.searchsorted(stops, i)])
            total += runs.price(stop - i, stop - i)
            i = stop
            if i == len(r):
                break
        x = int(r[i])
        total += states[context].price(int(unsigned(x)) - (context == 0), abs(x))
        i += 1
    return total


class BinaryCoder:
    """A 16-bit binary arithmetic coder with counts that are halved when they reach `most`; both directions."""

    HALF, QUARTER = 0x8000, 0x4000

    def __init__(self, contexts: int, bits: list[int] | None = None, most: int = 128):
        self.counts = [[1, 1] for _ in range(contexts)]
        self.low, self.high, self.most, self.pending = 0, 0xFFFF, most, 0
        self.out: list[int] = []
        self.source = iter(bits) if bits is not None else None
        self.code = 0
        if bits is not None:
            for _ in range(16):
                self.code = self.code * 2 + next(self.source, 0)

    def _bit(self, b: int) -> None:
        self.out.append(b)
        self.out.extend([1 - b] * self.pending)
        self.pending = 0

    def step(self, context: int, bit: int | None = None) -> int:
        """Code a bit, or decode and return the next one."""
        n = self.counts[context]
        width = self.high - self.low + 1
        split = min(width - 1, max(1, width * n[0] // (n[0] + n[1])))
        if self.source is not None:
            bit = int(self.code - self.low >= split)
        if bit:
            self.low += split
        else:
            self.high = self.low + split - 1
        n[bit] += 1
        if n[0] + n[1] >= self.most:
            n[0], n[1] = (n[0] + 1) // 2, (n[1] + 1) // 2
        while True:
            if self.high < self.HALF:
                shift = 0
            elif self.low >= self.HALF:
                shift = self.HALF
            elif self.low >= self.QUARTER and self.high < self.HALF + self.QUARTER:
                shift = self.QUARTER
            else:
                return bit
            if self.source is None:
                if shift == self.QUARTER:
                    self.pending += 1
                else:
                    self._bit(int(shift == self.HALF))
            else:
                self.code = (self.code - shift) * 2 + next(self.source, 0)
            self.low, self.high = (self.low - shift) * 2, (self.high - shift) * 2 + 1

    def finish(self) -> list[int]:
        self.pending += 1
        self._bit(int(self.low >= self.QUARTER))
        return self.out


#: Places of the prefix that have a context of their own.
PLACES = 16


def arithmetic_encode(residuals: np.ndarray, act: np.ndarray) -> tuple[list[int], list[int]]:
    """(coded prefix bits, raw suffix bits): exponential Golomb symbols whose prefixes go through the binary coder."""
    coder, raw = BinaryCoder(4 * PLACES), []
    for r, a in zip(residuals.ravel().tolist(), act.ravel().tolist(), strict=True):
        n = unsigned(r) + 1
        size = n.bit_length()
        for place in range(size):
            coder.step(a * PLACES + min(place, PLACES - 1), int(place == size - 1))
        raw.extend((n >> s) & 1 for s in range(size - 2, -1, -1))
    return coder.finish(), raw


def arithmetic_decode(bits: list[int], raw: list[int], act: np.ndarray) -> np.ndarray:
    coder, suffix, out = BinaryCoder(4 * PLACES, bits), iter(raw), []
    for a in act.ravel().tolist():
        place = 0
        while not coder.step(a * PLACES + min(place, PLACES - 1)):
            place += 1
        n = 1
        for _ in range(place):
            n = 2 * n + next(suffix)
        m = n - 1
        out.append((m + 1) // 2 if m % 2 else -(m // 2))
    return np.array(out).reshape(act.shape)


def _five_taps(plane: np.ndarray) -> np.ndarray:
    """Left, top and corners with copied borders, and the median whose corner is 0 outside, of every sample."""
    n = around(plane)
    return np.stack([n["a"], n["b"], n["c"], n["d"], med(*corners_zero(plane))], -1).reshape(-1, 5)


def sign_lms(plane: np.ndarray, least_error: int) -> np.ndarray:
    """Predictions of five taps (left, top, corners, median) whose weights follow the signs of errors and always sum to 16."""
    taps = _five_taps(plane)
    weights, out = [3, 3, 3, 3, 4], np.empty(len(taps), np.int64)
    for k, (x, y) in enumerate(zip(taps.tolist(), plane.ravel().tolist(), strict=True)):
        out[k] = p = (sum(w * v for w, v in zip(weights, x, strict=True)) + 8) // 16
        if abs(y - p) > least_error:
            middle, up = (sum(x) + 2) // 5, 1 if y > p else -1
            weights = [min(20, max(-8, w + up * ((v > middle) - (v < middle)))) for w, v in zip(weights, x, strict=True)]
            while (gap := 16 - sum(weights)) != 0:
                at = weights.index(min(weights) if gap > 0 else max(weights))
                weights[at] += 1 if gap > 0 else -1
    return out.reshape(plane.shape)


def magnitude_lms(plane: np.ndarray, shift: int = 3) -> np.ndarray:
    """Residuals of five taps whose weights move by a normalised step."""
    taps = _five_taps(plane)
    weights, out = [0, 0, 0, 0, 16], np.empty(len(taps), np.int64)
    for k, (x, y) in enumerate(zip(taps.tolist(), plane.ravel().tolist(), strict=True)):
        out[k] = e = y - (sum(w * v for w, v in zip(weights, x, strict=True)) >> 4)
        if e:
            power = (sum(v * v for v in x) >> 8) + 1
            step = abs(e) * 16 // (power << shift) + 1
            middle, up = (sum(x) + 2) // 5, 1 if e > 0 else -1
            for i, v in enumerate(x):
                if v != middle:
                    move = step * abs(v - middle) // 256 + 1
                    weights[i] = min(64, max(-64, weights[i] + (up if v > middle else -up) * move))
    return out.reshape(plane.shape)


def mixed(plane: np.ndarray, first: np.ndarray, second: np.ndarray, span: int = 64) -> np.ndarray:
    """Residuals of whichever of two predictions has had the smaller running error (the first if equal)."""
    errors, out = [0, 0], np.empty(plane.size, np.int64)
    for k, (y, *p) in enumerate(zip(plane.ravel().tolist(), first.ravel().tolist(), second.ravel().tolist(), strict=True)):
        use = int(errors[0] > errors[1])
        out[k] = y - p[use]
        size = abs(int(out[k]))
        gap = size - errors[use]
        errors[use] += gap // span + int(gap > 0 and gap % span >= span // 2)
        errors[1 - use] += (size - errors[1 - use]) // (4 * span)
    return out.reshape(plane.shape)


def closed_loop(plane: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(quantised residuals, reconstruction): predictions see reconstructed samples only."""
    step, back, out = 2 * tau + 1, np.zeros_like(plane), np.zeros_like(plane)
    for i, row in enumerate(plane.tolist()):
        for j, y in enumerate(row):
            left = int(back[i, j - 1]) if j else int(back[i - 1, j]) if i else 0
            top = int(back[i - 1, j]) if i else left
            corner = int(back[i - 1, j - 1]) if i and j else (left if j else top)
            p = int(med(left, top, corner))
            q = round((y - p) / step)
            out[i, j], back[i, j] = q, p + q * step
    return out, back


_LEVELS = (1, 3, 8, 22)
#: The most that a context's bias correction can be (a fixed value).
MOST_CORRECTION = 4


def _signed_level(g: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.digitize(np.abs(g), _LEVELS)


def loco(plane: np.ndarray, reset: int = 64) -> dict:
    """Bits of the complete low-complexity coder: run mode with interruptions, and contexts with bias correction.

    unbiased: the bits of the regular samples without the correction. Borders replicate the raster."""
    p = np.pad(plane, ((1, 0), (1, 1)), mode="edge")
    p[1:, 0] = plane[:, 0]
    a, b, c, d = p[1:, :-2], p[:-1, 1:-1], p[:-1, :-2], p[:-1, 2:]
    q = [_signed_level(g) for g in (b - c, c - a, d - b)]
    key = q[0] * 81 + q[1] * 9 + q[2]
    sign = np.where(key < 0, -1, 1)
    guess, flat = med(a, b, c), (a == b) & (b == c) & (c == d)
    lo, hi = int(plane.min()), int(plane.max())
    bias: dict[int, list[int]] = {}
    rates: dict[int, tuple[Rate, Rate]] = {}
    run_rate, out = Rate(reset=reset), {"regular": 0, "unbiased": 0, "run_bits": 0, "runs": 0, "interruptions": 0}
    for i, row in enumerate(plane.tolist()):
        j = 0
        while j < len(row):
            if flat[i, j]:
                stop = j
                while stop < len(row) and row[stop] == a[i, j]:
                    stop += 1
                out["run_bits"] += 2 * ((stop - j + 1).bit_length() - 1) + 1
                out["runs"] += 1
                if stop < len(row):
                    e = row[stop] - int(a[i, j])
                    out["run_bits"] += run_rate.price(2 * e if e >= 0 else -2 * e - 1, abs(e))
                    out["interruptions"] += 1
                j = stop + 1
                continue
            k, s = abs(int(key[i, j])), int(sign[i, j])
            state = bias.setdefault(k, [0, 0, 1])  # correction, sum of errors, count
            own, plain = rates.setdefault(k, (Rate(reset=reset), Rate(reset=reset)))
            corrected = min(hi, max(lo, int(guess[i, j]) + s * state[0]))
            for name, rate, p0 in (("regular", own, corrected), ("unbiased", plain, int(guess[i, j]))):
                e = s * (row[j] - p0)
                out[name] += rate.price(2 * e if e >= 0 else -2 * e - 1, abs(e))
            state[1] += s * (row[j] - corrected)
            state[2] += 1
            if state[1] <= -state[2]:
                state[0], state[1] = max(-MOST_CORRECTION, state[0] - 1), max(1 - state[2], state[1] + state[2])
            elif state[1] > 0:
                state[0], state[1] = min(MOST_CORRECTION, state[0] + 1), min(0, state[1] - state[2])
            if state[2] == reset:
                state[1], state[2] = -(-state[1] // 2), state[2] >> 1  # the sum is never above 0 here: halved towards 0
            j += 1
    return out


#: Window, least and most match, and links followed (fixed values of the format).
WINDOW, LEAST, MOST, TRIES = 4096, 4, 264, 32


def lz_encode(data: bytes) -> list[tuple[int, int]]:
    """Greedy matches (length, distance) and literals (byte, 0) from chains of equal three-byte beginnings."""
    chains: dict[bytes, list[int]] = {}
    out, i = [], 0
    while i < len(data):
        size, far = 0, 0
        for at in reversed(chains.get(data[i : i + 3], [])[-TRIES:]) if i + LEAST <= len(data) else ():
            if i - at > WINDOW:
                break
            n, most = 0, min(MOST, len(data) - i)
            while n < most and data[at + n] == data[i + n]:
                n += 1
            if n > size:
                size, far = n, i - at
                if n >= 32:
                    break
        step = size if size >= LEAST else 1
        out.append((size, far) if size >= LEAST else (data[i], 0))
        for k in range(i, i + step):
            chains.setdefault(data[k : k + 3], []).append(k)
        i += step
    return out


def lz_decode(tokens: list[tuple[int, int]]) -> bytes:
    out = bytearray()
    for x, far in tokens:
        if far:
            for _ in range(x):
                out.append(out[-far])
        else:
            out.append(x)
    return bytes(out)
