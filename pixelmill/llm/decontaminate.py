"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Patterns are the windows of `window` consecutive words of each benchmark item (an item with fewer words is
one shorter pattern). The search looks at the last block of two words under a window: a shift table, indexed
by the block's hash, tells how far the window can move without missing a pattern; where it says 0, the
patterns with that last block form a bucket, and a direct comparison of the words confirms an occurrence.

All windows of one length form one table, so that a short item does not shorten the shifts of the others.
Benchmark items are the stated query set: they are read in blocks of at most `block_words` words, one pass
over the documents per block, so no broadcast grows beyond that bound (a block of a million words takes about 100 MB:
windows are places in one buffer of words).

Nulls and texts without words have no words and no hits. A document may be of any length. Empty tables of either kind
give no hits. Equal windows of
several items count for each of them. Items with a null id can be hit but are not listed. Repeated rows are
judged row by row. Other columns pass through; columns of the names added here are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, LOWER, chunks, mapped, mix, read, word_hashes, written

_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
SHIFT_BITS = 18
SEGMENT = 256


def _block_hash(h: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    return mix(h[last] * _K2 + (h[last - 1] * _K1 if size == 2 else np.uint64(0)))


class Words:
    """The words of a block of items as one buffer, in which a space follows each word, and the hashes of the words."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids = [name for name, _ in items]
        parts: list[bytes] = []
        hashes, sizes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for _, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            start, stop, _, h = word_hashes(data, np.array([0, len(data)]), ALNUM)
            low = LOWER[data].tobytes()
            parts.append(b"".join(low[a:b] + b" " for a, b in zip(start.tolist(), stop.tolist(), strict=True)))
            hashes.append(h)
            sizes.append(stop - start)
            counts.append(len(h))
        self.buffer = b"".join(parts)
        self.h, size = np.concatenate(hashes), np.concatenate(sizes)
        self.start = np.concatenate([[0], np.cumsum(size + 1)])
        self.counts = np.array(counts, np.int64)

    def window(self, first: int, length: int) -> bytes:
        return self.buffer[self.start[first] : self.start[first + length] - 1]


class Table:
    """Shift table and buckets of the patterns of one length: `length` words of `words` from each of `first` on.

    Equal windows are one pattern. items[item_at[p]:item_at[p + 1]] are the numbers of the items that have pattern p."""

    def __init__(self, length: int, words: Words, first: np.ndarray, item: np.ndarray):
        self.length, self.block, self.words = length, min(2, length), words
        name = np.zeros(len(first), np.uint64)
        for j in range(length):
            name = mix(name * _K1 + words.h[first + j])
        order = np.lexsort((item, name))
        first, item, name = first[order], item[order], name[order]
        new = np.concatenate([[True], name[1:] != name[:-1]])
        begins = np.flatnonzero(new)
        of = first[begins][np.cumsum(new) - 1]
        for i in np.flatnonzero(~new).tolist():  # windows that hash alike are compared
            if words.window(int(first[i]), length) != words.window(int(of[i]), length):
                raise ValueError("two windows of the benchmark hash alike")
        self.first = first[begins].astype(np.int32)
        self.items, self.item_at = item.astype(np.int32), np.append(begins, len(item)).astype(np.int32)
        self.shift = np.full(1 << SHIFT_BITS, length - self.block + 1, np.uint8 if length < 256 else np.int64)
        for j in range(self.block - 1, length):
            keys = _block_hash(words.h, self.first.astype(np.int64) + j, self.block)
            np.minimum.at(self.shift, (keys >> np.uint64(64 - SHIFT_BITS)).astype(np.int64), length - 1 - j)
        last = _block_hash(words.h, self.first.astype(np.int64) + length - 1, self.block)
        order = np.argsort(last, kind="stable")
        self.bucket_key, self.bucket = last[order], order.astype(np.int32)

    def names(self, pattern: int) -> set[int]:
        return set(self.items[self.item_at[pattern] : self.item_at[pattern + 1]].tolist())

    def find(self, h: np.ndarray, first: np.ndarray, word) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence. word(i): the bytes of word i."""
        m = self.length
        lo, hi = first[:-1] + m - 1, first[1:]
        pieces = np.maximum(0, -(-(hi - lo) // SEGMENT))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(lo, pieces) + nth * SEGMENT
        end = np.minimum(at + SEGMENT, np.repeat(hi, pieces))
        stops = []
        while len(at):
            key = _block_hash(h, at, self.block)
            step = self.shift[(key >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)].astype(np.int64)
            if (zero := step == 0).any():
                a, k = at[zero], key[zero]
                i = np.searchsorted(self.bucket_key, k)
                real = self.bucket_key[np.minimum(i, len(self.bucket_key) - 1)] == k
                stops.append((a[real], i[real], k[real]))
            at = at + np.maximum(step, 1)
            if not (left := at < end).all():
                at, end = at[left], end[left]
        found = []
        for ats, i, keys in stops:
            for a, j, k in zip(ats.tolist(), i.tolist(), keys.tolist(), strict=True):
                seen = None
                while j < len(self.bucket_key) and int(self.bucket_key[j]) == k:
                    seen = seen or b" ".join(word(x) for x in range(a - m + 1, a + 1))
                    if self.words.window(int(self.first[p := int(self.bucket[j])]), m) == seen:
                        found.append((a - m + 1, p))
                        break
                    j += 1
        return found


def compiled(items: list[tuple[str | None, str | None]], window: int) -> tuple[list[Table], list[str | None]]:
    """The tables of a block of (id, text), and the ids by number."""
    words = Words(items)
    size = np.minimum(words.counts, window)
    windows = np.maximum(0, words.counts - size + 1) * (size > 0)
    item = np.repeat(np.arange(len(items)), windows)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = np.repeat(np.cumsum(words.counts) - words.counts, windows) + nth
    of = size[item]
    return [Table(int(n), words, first[of == n], item[of == n]) for n in np.unique(of)], words.ids


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item: tuple[str, str] = ("item_id", "text"), block_words: int = 1_000_000) -> DataFrame:
    """docs with n_words, hit_spans (runs [start, stop) of hit words) and hit_items (sorted ids)."""
    spark = docs.sparkSession
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    held: list[tuple[str | None, str | None]] = []
    blocks, size = [], 0
    rows = benchmark.select(F.col(item[0]).cast("string"), F.col(item[1])).toLocalIterator()
    for row in rows:
        n = len(row[1] or "") // 2 + 1  # a word and what parts it from the next take two characters at least
        if held and size + n > block_words:
            blocks.append(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    blocks.append(held)
    out = docs
    for k, block in enumerate(blocks):
        tables = spark.sparkContext.broadcast(compiled(block, window))
        out = mapped(out, _search(tables, text), [T.StructField(f"__{f.name}{k}", f.dataType) for f in fields])
        if k + 1 < len(blocks):
            out = written(out, "block")  # so that a worker holds the tables of one block only
    if len(blocks) == 1:
        made = {f.name: F.col(f"__{f.name}0") for f in fields}
    else:  # spans of several blocks: merge the sorted union with one fold
        spans = F.array_sort(F.flatten(F.array(*[F.col(f"__hit_spans{k}") for k in range(len(blocks))])))
        empty = F.array().cast(fields[1].dataType)
        fold = F.aggregate(spans, empty, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))))
        made = {"n_words": F.col("__n_words0"), "hit_spans": fold, "hit_items": F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"__hit_items{k}") for k in range(len(blocks))]))))}
    return out.withColumns(made).drop(*[f"__{f.name}{k}" for f in fields for k in range(len(blocks))])


def _search(shared, text: str):
    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        tables, ids = shared.value
        counts, spans, items = [], [], []
        for _, data, at in chunks(batch.column(text)):
            start, stop, first, h = word_hashes(data, at, ALNUM)
            low = LOWER[data].tobytes()
            hits: dict[int, list[tuple[int, int]]] = {}
            names: dict[int, set[int]] = {}
            for table in tables:
                for a, p in table.find(h, first, lambda i: low[start[i] : stop[i]]):
                    row = int(np.searchsorted(first, a, "right")) - 1
                    hits.setdefault(row, []).append((a - int(first[row]), a - int(first[row]) + table.length))
                    names.setdefault(row, set()).update(table.names(p))
            counts.append(np.diff(first))
            for row in range(len(at) - 1):
                if row not in hits:
                    spans.append([])
                    items.append([])
                    continue
                runs: list[list[int]] = []
                for a, b in sorted(hits[row]):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                spans.append([{"start": a, "stop": b} for a, b in runs])
                items.append(sorted({ids[i] for i in names[row] if ids[i] is not None}))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return [pa.array(np.concatenate(counts), pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

    return step


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """occurrences() with n_hit and contaminated: a twentieth of the words or more is hit."""
    out = occurrences(docs, benchmark, **options)
    out = out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns (also those that judged() would replace)."""
    added = {"n_words", "hit_spans", "hit_items", "n_hit", "contaminated"}
    apart = docs.select([F.col(f"`{c}`").alias(f"__own_{c}" if c.lower() in added else c) for c in docs.columns])
    out = judged(apart, benchmark, **options).filter(~F.col("contaminated"))
    return out.select([F.col(f"`{a}`").alias(c) for a, c in zip(apart.columns, docs.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: see the contract; one row per document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
