"""Removal of repeated substrings by suffix sorting, deep-shallow style.

Every byte is removed that a string of `length` bytes covers which also starts elsewhere in the corpus (in the
same text too; overlaps count; judged on the input).

Sorting all suffixes of a corpus is not needed to find the long matches: any `length` bytes hold an anchor, a
gram of GRAM bytes whose hash is the least of the grams in some window of that length, and equal strings have
equal anchors. So only suffixes at anchors (about one byte in 77) are dealt out, by gram. Where the whole
surroundings of an anchor recur (compared as one hash), all around it is repeated. Else the suffixes at equal
anchors are sorted, forwards and backwards from the anchor, by deep-shallow sorting: multikey quicksort on
eight-byte symbols to a shallow depth, then a blind trie for every group that still ties. Common prefix
lengths of the two orders then tell which strings around the anchor recur, and where. A gram with more different
surroundings than a task should hold (HOT_GROUP) has its windows dealt out by digest instead.

A text that occurs twice or more is repeated from end to end if it has `length` bytes; a task deals out its suffixes
once. Anchors whose surroundings recur within a batch are settled before the shuffle, so a very common passage sends
few rows. Texts are named by a 64-bit digest of their own, not by their ids: rows with null ids, repeated ids and
repeated rows are judged like all others, each by its text. Null and empty texts, and those under `length` bytes, keep
everything. A text is read whole, whatever its length. Ids may be of any type; other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunks, hand_back, hot_join, mapped, mix, prefix_hash, read, span_hash, written

GRAM = 48
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 24
#: Different surroundings of one gram that one task sorts; beyond, windows are dealt out by their digests.
HOT_GROUP = 100_000
#: Anchors of whole groups that are settled together.
HELD = 1 << 20
#: Up to so many suffixes at one anchor are compared in pairs of their sorted orders.
PAIRS = 32
_RAW = np.arange(1, 257, dtype=np.uint64)


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick over each `size` consecutive values, by doubling."""
    done = 1
    while done * 2 <= size:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    return pick(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, gram's hash, surroundings' hash) of every anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_hash(data, _RAW)
    start = np.arange(len(data) - GRAM + 1)
    gram = span_hash(sums, start, start + GRAM)
    grams = length - GRAM + 1
    low = _slide(gram, grams, np.minimum)  # of the window that starts here
    size = np.diff(at)
    valid = np.zeros(len(low) + 1, np.int64)  # windows must not leave their row
    whole = size >= length
    np.add.at(valid, at[:-1][whole], 1)
    np.add.at(valid, at[1:][whole] - length + 1, -1)
    low[np.cumsum(valid[:-1]) == 0] = 0
    edge = np.zeros(grams - 1, np.uint64)
    best = _slide(np.concatenate([edge, low, edge]), grams, np.maximum)  # over the windows that hold this gram
    place = np.flatnonzero((best == gram) & (gram > 0))
    row = np.searchsorted(at, place, "right") - 1
    left, right = np.maximum(at[row], place - (length - GRAM)), np.minimum(at[row + 1], place + length)
    around = span_hash(sums, left, right) + (place - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row, place - at[row], gram[place], mix(around + (right - place).astype(np.uint64))


#: Kinds of dealt-out anchors: one whose surroundings the task saw once, one that stands for several, and those
#: several, which need no partner any more.
LONE, SEVERAL, SETTLED = 0, 1, 2


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(gram, around, id, pos, kind) of all anchors. Surroundings that recur within a batch are settled there: one of
    them is dealt out by gram to meet those of other batches, and all go on under a scattered gram."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            parts = []
            for first, data, at in chunks(batch.column("text")):
                keep = []
                for i in range(len(at) - 1):
                    h = xxhash.xxh3_128_intdigest(data[at[i] : at[i + 1]])
                    keep.append(h not in done)
                    done.add(h)
                row, pos, gram, around = anchors(data, at, length)
                use = np.array(keep)[row] if len(row) else np.zeros(0, bool)
                parts.append((gram[use], around[use], ids[first + row[use]], pos[use]))
            gram, around, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(gram):
                continue
            order = np.lexsort((around, gram))
            gram, around, doc, pos = gram[order], around[order], doc[order], pos[order]
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])])
            size = np.diff(np.append(np.flatnonzero(new), len(gram)))
            many = np.repeat(size > 1, size)
            scattered = mix(doc[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos[many].astype(np.uint64))
            kinds = np.concatenate([np.where(size > 1, SEVERAL, LONE), np.full(many.sum(), SETTLED)])
            both = [np.concatenate([x[new], y]) for x, y in ((gram, scattered), (around, around[many]), (doc, doc[many]), (pos, pos[many]))]
            yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.array(both[2], pa.int64()), pa.array(both[3], pa.int64()), pa.array(kinds, pa.int8())], names=["gram", "around", "id", "pos", "kind"])

    return docs.mapInArrow(run, "gram long, around long, id long, pos long, kind byte")


#: What is left to do with anchors: nothing (their surroundings recur), sort their suffixes, or compare windows one by one.
ALIKE, SORT, CROWDED = 0, 1, 2


def _groups(batches, crowd: int):
    """(todo, gram, id, pos) of the anchors whose gram recurs; batches are in the order of grams."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(np.asarray(c) for c in b.columns)
        gram = rows[0]
        last = int(np.searchsorted(gram, gram[-1]))  # where the last gram, which may go on, begins
        if size + last >= HELD and (last or gram[0] != held[-1][0][-1]):
            yield from _settled([*held, tuple(x[:last] for x in rows)], crowd)
            held, size = [], 0
            rows = tuple(x[last:] for x in rows)
        held.append(rows)
        size += len(rows[0])
    if held:
        yield from _settled(held, crowd)


def _settled(held: list[tuple[np.ndarray, ...]], crowd: int):
    """The rows of _groups() for anchors (gram, around, id, pos, kind), with all of each gram."""
    gram, around, doc, pos, kind = (np.concatenate(x) for x in zip(*held, strict=True))
    settled = kind == SETTLED
    out = [(ALIKE, gram[settled], doc[settled], pos[settled])]
    gram, around, doc, pos, kind = (x[~settled] for x in (gram, around, doc, pos, kind))
    if len(gram):
        order = np.lexsort((around, gram))
        gram, around, doc, pos, kind = (x[order] for x in (gram, around, doc, pos, kind))
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(gram)))
        kinds_at = np.flatnonzero(new_gram)
        kinds = np.repeat(np.add.reduceat(new.astype(np.int64), kinds_at), np.diff(np.append(kinds_at, len(gram))))
        # those that stand for several are settled already, but settle the lone ones that they meet
        alike = np.repeat(size, size) > 1
        for todo, mask in ((ALIKE, alike & (kind == LONE)), (SORT, (kinds > 1) & (kinds <= crowd) & new), (CROWDED, (kinds > crowd) & new)):
            out.append((todo, gram[mask], doc[mask], pos[mask]))
    for todo, g, i, p in out:
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), todo), pa.int8()), pa.array(g), pa.array(i), pa.array(p)], names=["todo", "gram", "id", "pos"])


def common(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with alike."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class _Trie:
    """A blind trie: inner nodes know only how many bytes their strings share and the byte that follows."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, [first]  # a leaf is a list of equal strings, a node (depth, {byte: child})

    def _leaf(self, s: bytes):
        x = self.root
        while isinstance(x, tuple):
            depth, sons = x
            x = sons.get(s[depth] if depth < len(s) else -1) or next(iter(sons.values()))
        return x

    def add(self, i: int) -> None:
        s = self.strings[i]
        leaf = self._leaf(s)
        other = self.strings[leaf[0]]
        shared = common(s, other)
        if shared == len(s) == len(other):
            leaf.append(i)
            return
        up, x = None, self.root
        while isinstance(x, tuple) and x[0] < shared:
            key = s[x[0]]
            up, x = (x, key), x[1][key]
        mine = s[shared] if shared < len(s) else -1
        if isinstance(x, tuple) and x[0] == shared:
            x[1][mine] = [i]
            return
        theirs = other[shared] if shared < len(other) else -1
        node = (shared, {mine: [i], theirs: x})
        if up is None:
            self.root = node
        else:
            up[0][1][up[1]] = node

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string, bytes shared with the one before) in order; the first shares -1."""
        stack = [(self.root, -1)]
        while stack:
            x, shared = stack.pop()
            if isinstance(x, list):
                size = len(self.strings[x[0]])
                yield x[0], shared
                for i in x[1:]:
                    yield i, size
            else:
                depth, sons = x
                keys = sorted(sons)
                stack += [(sons[k], depth if n else shared) for n, k in reversed(list(enumerate(keys)))]


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the bytes each shares with the one before (0 for the first)."""
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1 or depth >= SHALLOW:
            trie = _Trie(strings, group[0])
            for i in group[1:]:
                trie.add(i)
            for i, n in trie.walk():
                shared.append((common(strings[order[-1]], strings[i]) if order else 0) if n < 0 else n)
                order.append(i)
            continue
        symbols = {i: strings[i][depth : depth + 8] for i in group}
        pivot = sorted((symbols[group[0]], symbols[group[len(group) // 2]], symbols[group[-1]]))[1]
        less = [i for i in group if symbols[i] < pivot]
        more = [i for i in group if symbols[i] > pivot]
        same = [i for i in group if symbols[i] == pivot]
        stack += [(g, d) for g, d in ((more, depth), (same, depth + 8 if len(pivot) == 8 else SHALLOW), (less, depth)) if g]
    return order, shared


def repeats(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For the texts around each of several equal anchors (lefts reversed), the repeated stretches as (bytes before, bytes after)."""
    m = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m == 2:
        a, b = common(*lefts), common(*rights)
        return [[(a, b)], [(a, b)]] if a + b >= length else out
    sides = []
    for strings in (lefts, rights):
        order, shared = deep_shallow(strings)
        sides.append((np.array(order), np.array(shared)))
    if m <= PAIRS:
        both = []
        for order, shared in sides:
            near = np.zeros((m, m), np.int64)
            for i in range(m - 1):
                near[order[i], order[i + 1 :]] = np.minimum.accumulate(shared[i + 1 :])
            both.append(np.maximum(near, near.T))
        for i, j in zip(*np.nonzero(both[0] + both[1] >= length), strict=True):
            if i != j:
                out[i].append((int(both[0][i, j]), int(both[1][i, j])))
        return out
    for before in range(length - GRAM + 1):
        names = []
        for (order, shared), least in zip(sides, (before, length - before), strict=True):
            # neighbours that share enough bytes are of one class; strings too short for that are alone
            cls = np.empty(m, np.int64)
            cls[order] = np.cumsum(np.concatenate([[True], shared[1:] < least]))
            names.append(cls)
        name, count = np.unique(names[0] * (m + 1) + names[1], return_inverse=True, return_counts=True)[1:]
        for i in np.flatnonzero(count[name] > 1).tolist():
            stretch = out[i]
            if stretch and stretch[-1][0] == before - 1:
                stretch[-1] = (before, stretch[-1][1])  # the stretch grows to the left
            else:
                stretch.append((before, length - before))
    return out


def _sorted(batches, length: int):
    """(id, lo, hi): repeated stretches around the anchors in batches (gram, id, pos, before, after), in the order of grams."""

    def told(group: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
        for (doc, pos, _, _), found in zip(group, repeats([g[2] for g in group], [g[3] for g in group], length), strict=True):
            for a, b in found:
                yield doc, pos - a, pos + b

    def packed(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["id", "lo", "hi"])

    rows: list[tuple[int, int, int]] = []
    group: list[tuple[int, int, bytes, bytes]] = []
    now = None
    for b in batches:
        for gram, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if gram != now:
                rows += told(group) if len(group) > 1 else ()
                now, group = gram, []
                if len(rows) >= 1 << 16:
                    yield packed(rows)
                    rows = []
            group.append(tuple(rest))
    rows += told(group) if len(group) > 1 else ()
    if rows:
        yield packed(rows)
    hand_back()


def _contexts(batches, length: int):
    """(gram, id, pos, before, after) for batches (id, text, places: [(gram, pos)])."""
    for batch in batches:
        rows = ([], [], [], [], [])
        for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "places")), strict=True):
            data = (text or "").encode()
            for i, p in ((p["pos"], p) for p in places if p["todo"] == SORT):
                before = data[max(0, i - (length - GRAM)) : i][::-1]
                for column, x in zip(rows, (p["gram"], doc, i, before, data[i : i + length]), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["gram", "id", "pos", "before", "after"])


def _windows(batches, length: int):
    """(digest, id, lo) of every window around the places of batches (id, text, places)."""
    for batch in batches:
        digests, ids, los = [], [], []
        for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "places")), strict=True):
            data = (text or "").encode()
            starts = {x for p in places if p["todo"] == CROWDED for x in range(max(0, p["pos"] - (length - GRAM)), min(p["pos"], len(data) - length) + 1)}
            for x in sorted(starts):
                digests.append(xxhash.xxh3_128_digest(data[x : x + length]))
                ids.append(doc)
                los.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(los, pa.int64())], names=["digest", "id", "lo"])


def _once(docs: DataFrame) -> DataFrame:
    """docs (id, text) with each text at most once a task, so that copies of one text are as many as tasks at most."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            keep = []
            for x in batch.column("id").to_pylist():
                keep.append(x not in done)
                done.add(x)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(id, spans: [(lo, hi)]) of docs (id: the text's name, text): stretches of bytes that recur; they may overlap."""
    known = docs.filter(F.octet_length("text") >= length)
    dealt = _anchor_rows(known, length).repartition("gram").sortWithinPartitions("gram")
    found = written(dealt.mapInArrow(lambda b, crowd=HOT_GROUP: _groups(b, crowd), "todo byte, gram long, id long, pos long"), "anchors")
    alike = found.filter(F.col("todo") == ALIKE).select("id", F.greatest(F.lit(0), F.col("pos") - (length - GRAM)).alias("lo"), (F.col("pos") + length).alias("hi"))
    # both uses of this join stand in one plan and share its shuffles
    places = found.filter(F.col("todo") != ALIKE).groupBy("id").agg(F.collect_set(F.struct("todo", "gram", "pos")).alias("places"))
    met = _once(known).join(places, "id").select("id", "text", "places")
    around = met.mapInArrow(lambda b: _contexts(b, length), "gram long, id long, pos long, before binary, after binary")
    around = around.repartition("gram").sortWithinPartitions("gram")
    spans = alike.unionAll(around.mapInArrow(lambda b: _sorted(b, length), "id long, lo long, hi long"))
    if not found.filter(F.col("todo") == CROWDED).isEmpty():
        windows = met.mapInArrow(lambda b: _windows(b, length), "digest binary, id long, lo long").distinct()
        many = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        spans = spans.unionAll(hot_join(windows, many, ["digest"], "n", windows.count()).select("id", "lo", (F.col("lo") + length).alias("hi")))
    return spans.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def copies(docs: DataFrame, length: int) -> DataFrame:
    """(id, n) of texts of `length` bytes or more that occur more than once; docs (id: the text's name, text)."""
    size = F.octet_length("text")
    named = docs.filter(size >= length).groupBy("id", F.xxhash64("text", F.lit(1)).alias("second"), size.alias("size"))
    return named.agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("id").agg(F.sum("n").alias("n"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """key, n_bytes, removed (maximal runs of bytes as (lo, hi)) and kept (binary: the bytes that are left)."""
    docs = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    docs = docs.withColumn("id", F.xxhash64("text"))
    whole = written(copies(docs, length), "copies")
    spans = repeated_spans(docs.select("id", "text"), length).join(whole.select("id"), "id", "left_anti")
    table = spans.select("id", "spans", F.lit(1).cast("long").alias("n")).unionByName(whole, allowMissingColumns=True)
    table = written(table, "spans")
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))), T.StructField("kept", T.BinaryType())]

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, removed, kept = [], [], []
        for text, spans, n in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "n")), strict=True):
            data = text.encode()
            copied = n is not None and n > 1
            runs: list[list[int]] = [[0, len(data)]] if copied else []
            if not copied:
                for lo, hi in sorted((s["lo"], min(s["hi"], len(data))) for s in spans or []):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(hi, runs[-1][1])
                    else:
                        runs.append([lo, hi])
            edges = [0, *(x for r in runs for x in r), len(data)]
            sizes.append(len(data))
            removed.append([{"lo": a, "hi": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())]

    out = mapped(hot_join(docs, table, ["id"], "n", docs.count(), "left").select("key", "text", "spans", "n"), step, fields)
    return out.select(F.col("key").alias(key), "n_bytes", "removed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: see the contract; one row per document."""
    out = without_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
