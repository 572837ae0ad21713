"""Bit streams: canonical Huffman, Golomb and range coding of a plane's residuals, and back."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa

from .folds import around, med

SCALE_BITS = 14
STATE_LEAST = 1 << 20


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of an optimal prefix code; of equal weights the older node goes first, leaves by symbol."""
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    lengths, fresh = Counter(), len(heap)
    while len(heap) > 1:
        n, _, x = heapq.heappop(heap)
        m, _, y = heapq.heappop(heap)
        lengths.update(x + y)
        heapq.heappush(heap, (n + m, fresh, x + y))
        fresh += 1
    return dict(lengths)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """{symbol: (code, length)} in the order of (length, symbol)."""
    out, code, before = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - before
        out[s], before = (code, lengths[s]), lengths[s]
        code += 1
    return out


def huffman_pack(symbols: list[int], codes: dict[int, tuple[int, int]]) -> tuple[bytes, int]:
    bits = "".join(f"{c:0{n}b}" for c, n in map(codes.__getitem__, symbols))
    return int(bits or "0", 2).to_bytes((len(bits) + 7) // 8 or 1, "big"), len(bits)


def huffman_unpack(data: bytes, n_bits: int, codes: dict[int, tuple[int, int]]) -> list[int]:
    back = {(n, c): s for s, (c, n) in codes.items()}
    bits = f"{int.from_bytes(data, 'big'):0{n_bits}b}" if n_bits else ""
    out, code, size = [], 0, 0
    for b in bits:
        code, size = code * 2 + (b == "1"), size + 1
        s = back.get((size, code))
        if s is not None:
            out.append(s)
            code = size = 0
    return out


def golomb_pack(values: list[int], k: int, ones: bool = False) -> str:
    """Unary quotients (zeros ended by a one; with `ones` the other way round), then k low bits."""
    fill, end = ("1", "0") if ones else ("0", "1")
    return "".join(fill * (v >> k) + end + (f"{v & ((1 << k) - 1):0{k}b}" if k else "") for v in values)


def golomb_unpack(bits: str, k: int, ones: bool = False) -> list[int]:
    end, out, i = "0" if ones else "1", [], 0
    while i < len(bits):
        stop = bits.index(end, i)
        low = bits[stop + 1 : stop + 1 + k]
        out.append(((stop - i) << k) + (int(low, 2) if k else 0))
        i = stop + 1 + k
    return out


def frequencies(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """{symbol: (frequency, start)} that sum to 2^14; what rounding leaves goes to the first commonest symbol.

    Many rare symbols rounded up can take more than that symbol has: it keeps 1, and the next commonest give the rest."""
    total, scale = sum(counts.values()), 1 << SCALE_BITS
    if len(counts) > scale:
        raise ValueError(f"{len(counts)} symbols don't fit {scale} slots")
    f = {s: max(1, (counts[s] * scale + total // 2) // total) for s in sorted(counts)}
    rest = scale - sum(f.values())
    for s in sorted(f, key=lambda s: (-counts[s], s)):
        given = max(rest, 1 - f[s])
        f[s] += given
        rest -= given
        if not rest:
            break
    out, at = {}, 0
    for s, n in f.items():
        out[s] = (n, at)
        at += n
    return out


def range_encode(symbols: list[int], table: dict[int, tuple[int, int]]) -> bytes:
    x, out = STATE_LEAST, bytearray()
    for s in reversed(symbols):
        n, start = table[s]
        while x >= (STATE_LEAST >> SCALE_BITS << 8) * n:
            out.append(x & 0xFF)
            x >>= 8
        q, r = divmod(x, n)
        x = (q << SCALE_BITS) + r + start
    return bytes(out) + x.to_bytes(4, "little")


def range_decode(data: bytes, n: int, table: dict[int, tuple[int, int]]) -> list[int]:
    slots = np.empty(1 << SCALE_BITS, np.int64)
    for s, (f, start) in table.items():
        slots[start : start + f] = s
    x, rest, out = int.from_bytes(data[-4:], "little"), bytearray(data[:-4]), []
    for _ in range(n):
        slot = x & ((1 << SCALE_BITS) - 1)
        s = int(slots[slot])
        f, start = table[s]
        out.append(s)
        x = f * (x >> SCALE_BITS) + slot - start
        while x < STATE_LEAST and rest:
            x = x << 8 | rest.pop()
    return out


def residuals(plane: np.ndarray) -> np.ndarray:
    n = around(plane)
    return plane - med(n["a"], n["b"], n["c"])


def rebuilt(r: np.ndarray) -> np.ndarray:
    """The plane whose median-edge residuals are r, sample by sample."""
    h, w = r.shape
    out = [[0] * w for _ in range(h)]
    for i, row in enumerate(r.tolist()):
        for j, e in enumerate(row):
            left = out[i][j - 1] if j else out[i - 1][j] if i else 0
            top = out[i - 1][j] if i else left
            corner = out[i - 1][j - 1] if i and j else (left if j else top)
            hi, lo = (left, top) if left > top else (top, left)
            out[i][j] = e + (lo if corner >= hi else hi if corner <= lo else left + top - corner)
    return np.array(out)


def designed(r: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """The symbols of r in order, and the lengths of an optimal code for them."""
    values, counts = np.unique(r, return_counts=True)
    return r.ravel().tolist(), code_lengths(dict(zip(values.tolist(), counts.tolist(), strict=True)))


def encode_plane(p: np.ndarray) -> dict:
    flat, sizes = designed(residuals(p))
    data, n_bits = huffman_pack(flat, canonical(sizes))
    table = np.array(sorted(sizes.items()), dtype="<i2").tobytes()
    return {"height": p.shape[0], "width": p.shape[1], "table": table, "payload": data, "payload_bits": n_bits}


def decode_planes(batches):
    """(img, ch, i, row) of batches of coded planes."""
    for b in batches:
        for img, ch, h, w, table, data, n_bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            codes = canonical(dict(np.frombuffer(table, "<i2").reshape(-1, 2).tolist()))
            p = rebuilt(np.array(huffman_unpack(data, n_bits, codes)).reshape(h, w))
            yield pa.RecordBatch.from_arrays([pa.array([img] * h, pa.int64()), pa.array([ch] * h, pa.int32()), pa.array(range(h), pa.int32()), pa.array(p.tolist(), pa.list_(pa.int32()))], names=["img", "ch", "i", "row"])


class BitSource:
    """Reads codes and numbers from a string of bits."""

    def __init__(self, bits: str):
        self.bits, self.at = bits, 0

    def number(self, size: int) -> int:
        self.at += size
        return int(self.bits[self.at - size : self.at] or "0", 2)

    def gamma(self) -> int:
        size = self.bits.index("1", self.at) - self.at
        self.at += size
        return self.number(size + 1)

    def symbol(self, back: dict[tuple[int, int], int]) -> int:
        code, size = 0, 0
        while True:
            code, size = code * 2 + (self.bits[self.at] == "1"), size + 1
            self.at += 1
            s = back.get((size, code))
            if s is not None:
                return s


def gamma(n: int) -> str:
    return "0" * (n.bit_length() - 1) + f"{n:b}"


def neighbourhood(out: list[list[int]], i: int, j: int) -> tuple[int, int, int, int, int, int]:
    """a, b, c, d, ww and nne of a sample from those decoded before it."""
    if not i and not j:
        return 0, 0, 0, 0, 0, 0
    row, up = out[i], out[i - 1] if i else None
    a = row[j - 1] if j else up[0]
    b = up[j] if i else a
    c = (up[j - 1] if j else b) if i else a
    d = (up[j + 1] if j + 1 < len(row) else b) if i else a
    return a, b, c, d, row[j - 2] if j > 1 else a, out[i - 2][j] if i > 1 else b


def energy_class(n: tuple[int, ...]) -> int:
    return min(8, (abs(n[0] - n[2]) + abs(n[1] - n[2])) >> 4)


def middle(n: tuple[int, ...]) -> int:
    a, b, c = n[:3]
    return sorted((a, b, a + b - c))[1]


def _gap(n: tuple[int, ...], threshold: int = 80) -> int:
    a, b, c, d, ww, nne = n
    step = abs(a - c) + abs(b - nne) + abs(d - b) - abs(a - ww) - abs(b - c) - abs(b - d)
    return a if step > threshold else b if step < -threshold else (a + b) // 2 + (d - c) // 4


#: Experts that a block chooses among, in their order.
BLOCK_EXPERTS = (middle, lambda n: n[1], lambda n: n[0], lambda n: (n[0] + n[1]) // 2 + (n[1] - n[2]) // 4, _gap, lambda n: n[0] + n[1] - n[2])


def plane_stream(plane: np.ndarray, experts: np.ndarray | None = None, runs: bool = False) -> tuple[str, dict[int, dict[int, tuple[int, int]]]]:
    """(bits, codes by energy class): an expert a block of 8 x 8 (3 bits each; without them the median), residuals under
    their energy class's code, and runs in flat neighbourhoods as gamma codes."""
    rows = plane.tolist()
    events: list[tuple[int, int]] = []  # (class, residual) or (-1, run length)
    for i, row in enumerate(rows):
        j, forced = 0, False
        while j < len(row):
            n = neighbourhood(rows, i, j)
            if runs and not forced and (i or j) and j + 1 < len(row) and n[0] == n[1] == n[2] == n[3]:
                stop = j
                while stop < len(row) and row[stop] == n[0]:
                    stop += 1
                events.append((-1, stop - j))
                j, forced = stop, True
                continue
            guess = BLOCK_EXPERTS[experts[i // 8, j // 8]](n) if experts is not None else middle(n)
            events.append((energy_class(n), row[j] - guess))
            j, forced = j + 1, False
    counts: dict[int, Counter] = {}
    for e, r in events:
        if e >= 0:
            counts.setdefault(e, Counter())[r] += 1
    codes = {e: canonical(code_lengths(dict(c))) for e, c in counts.items()}
    head = "".join(f"{x:03b}" for x in experts.ravel().tolist()) if experts is not None else ""
    return head + "".join(gamma(r + 1) if e < 0 else f"{codes[e][r][0]:0{codes[e][r][1]}b}" for e, r in events), codes


def plane_from_stream(bits: str, codes: dict[int, dict[int, tuple[int, int]]], shape: tuple[int, int], experts: bool = False, runs: bool = False) -> np.ndarray:
    h, w = shape
    source, out = BitSource(bits), [[0] * w for _ in range(h)]
    blocks = [[source.number(3) for _ in range(-(-w // 8))] for _ in range(-(-h // 8))] if experts else None
    back = {e: {(size, code): s for s, (code, size) in c.items()} for e, c in codes.items()}
    for i in range(h):
        j, forced = 0, False
        while j < w:
            n = neighbourhood(out, i, j)
            if runs and not forced and (i or j) and j + 1 < w and n[0] == n[1] == n[2] == n[3]:
                size = source.gamma() - 1
                out[i][j : j + size] = [n[0]] * size
                j, forced = j + size, True
                continue
            guess = BLOCK_EXPERTS[blocks[i // 8][j // 8]](n) if experts else middle(n)
            out[i][j] = guess + source.symbol(back[energy_class(n)])
            j, forced = j + 1, False
    return np.array(out)


def block_choice(plane: np.ndarray) -> np.ndarray:
    """The expert of least error of each 8 x 8 block."""
    rows = plane.tolist()
    h, w = plane.shape
    errors = np.zeros((-(-h // 8), -(-w // 8), len(BLOCK_EXPERTS)), np.int64)
    for i in range(h):
        for j in range(w):
            n = neighbourhood(rows, i, j)
            errors[i // 8, j // 8] += [abs(rows[i][j] - x(n)) for x in BLOCK_EXPERTS]
    return errors.argmin(-1)


def huffman_total(counts: Counter) -> int:
    """Bits of an optimal code with its table: 16, and 24 a symbol."""
    return _table_bits(list(counts.values()))


def _table_bits(heap: list[int]) -> int:
    if not heap:
        return 0
    heapq.heapify(heap)
    bits = heap[0] if len(heap) == 1 else 0
    alphabet = len(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        bits += x
        heapq.heappush(heap, x)
    return bits + 16 + 24 * alphabet


def merged_groups(parts: dict[int, Counter]) -> tuple[dict[int, int], int]:
    """({part: group}, bits): parts are united two by two, the pair that saves most first, while anything is saved."""
    groups, price = {k: [k] for k in parts}, {k: huffman_total(c) for k, c in parts.items()}
    held = dict(parts)
    gains = {(x, y): price[x] + price[y] - huffman_total(held[x] + held[y]) for x in held for y in held if x < y}
    while gains and max(gains.values()) > 0:
        x, y = min(gains, key=lambda p: (-gains[p], p))
        held[x], price[x] = held[x] + held[y], price[x] + price[y] - gains[x, y]
        groups[x] += groups.pop(y)
        del held[y], price[y]
        gains = {p: g for p, g in gains.items() if not {x, y} & set(p)} | {(min(x, z), max(x, z)): price[x] + price[z] - huffman_total(held[x] + held[z]) for z in held if z != x}
    return {k: g for g, ks in groups.items() for k in ks}, sum(price.values())


def refined_cuts(order: list[Counter], cuts: list[int], reach: int = 8, rounds: int = 2) -> tuple[list[int], int]:
    """(cuts, bits): cuts of an ordered list of histograms moved by up to `reach` places while that strictly saves."""
    symbols = {s: k for k, s in enumerate(sorted(set().union(*order)))}
    sums = np.zeros((len(order) + 1, len(symbols)), np.int64)
    for k, c in enumerate(order):
        for s, n in c.items():
            sums[k + 1, symbols[s]] = n
    sums = sums.cumsum(0)
    part = lambda a, b: _table_bits([x for x in (sums[b] - sums[a]).tolist() if x])
    total = lambda at: sum(part(a, b) for a, b in zip([0, *at], [*at, len(order)], strict=True))
    best = total(cuts)
    for _ in range(rounds):
        for k in range(len(cuts)):
            low, high = cuts[k - 1] + 1 if k else 1, cuts[k + 1] - 1 if k + 1 < len(cuts) else len(order) - 1
            for to in range(max(low, cuts[k] - reach), min(high, cuts[k] + reach) + 1):
                now = [*cuts[:k], to, *cuts[k + 1 :]]
                if (bits := total(now)) < best:
                    cuts, best = now, bits
    return cuts, best


def grown_tree(features: np.ndarray, residual: np.ndarray, leaves: int = 8, depth: int = 3, least: int = 64, price: int = 27) -> list[dict]:
    """Leaves of a tree that splits where data, tables and the split together cost least, best gain first."""
    count = lambda m: Counter(residual[m].tolist())
    tree = [(np.ones(len(residual), bool), 0, "")]
    done = False
    while not done and len(tree) < leaves:
        best = None
        for at, (m, level, _) in enumerate(tree):
            if level >= depth or m.sum() < 2 * least:
                continue
            whole = huffman_total(count(m))
            for f in range(features.shape[1]):
                for cut in np.unique(np.quantile(features[m, f], (0.25, 0.5, 0.75), method="lower")):
                    side = m & (features[:, f] <= cut)
                    if least <= side.sum() <= m.sum() - least:
                        gain = whole - huffman_total(count(side)) - huffman_total(count(m & ~side)) - price
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, at, f, int(cut), side)
        done = best is None
        if best:
            _, at, f, cut, side = best
            m, level, name = tree.pop(at)
            tree += [(side, level + 1, f"{name}/{f}<={cut}"), (m & ~side, level + 1, f"{name}/{f}>{cut}")]
    return [{"leaf": name or "/", "n": int(m.sum()), "bits": huffman_total(count(m))} for m, _, name in tree]
