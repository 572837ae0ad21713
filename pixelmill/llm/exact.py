"""Exact duplicates through counting quotient filters.

A fingerprint is cut into a range (its leading bits, the unit of merging), a quotient and a remainder. Each
partition fills one counting quotient filter per range: the quotient names a slot, the remainders of one
quotient stand in a sorted run at that slot or as soon after it as there is room, and a count above one follows
its remainder in slots of its own. Three bits a slot say which quotients occur, where runs end and which slots
count. Filters travel as their packed bytes. Those of one range merge losslessly by walking their sorted runs and
adding counts, one range at a time. The fingerprint's width follows the row count, so that about one text in
2^24 shares a fingerprint with another text.

A fingerprint with a count of one is a text that stands alone. Fingerprints with a higher count route their texts
to byte verification: they go to the scan as one more quotient filter if they are at most `most_sent`, else through
a join (those of very many rows by broadcast), and the texts that pass are grouped by their normalised bytes, which
are combined within each task before the shuffle, so that a huge group sends a few rows. Texts that pass by
chance are found to be alone there.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
id stays; a null id is smallest, and of repeated rows with the largest id all are marked as kept. Texts are handled
whole, whatever their length. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import hand_back, hot_join, mapped, read, written

#: Fingerprints of a partition that are held before they become filters.
HELD = 1 << 22
#: Rows of the corpus for each range of the merge, and the fewest ranges.
RANGE_ROWS, LEAST_RANGE_BITS = 1 << 20, 5
#: Repeated fingerprints that are sent to every task as a filter (at most 12 bytes each), and its bits.
MOST_SENT = 2_000_000


def _lowered(value: str | None) -> bytes:
    return (value or "").encode().lower()  # of bytes, lower() changes A-Z only


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """A counting quotient filter over fingerprints of `bits` bits: a quotient of q bits and a remainder of r.

    slots: remainders and digits of counts; occupied: by quotient; ends and counts: by slot."""

    def __init__(self, bits: int, q: int, slots: np.ndarray, occupied: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.bits, self.q, self.r = bits, q, bits - q
        self.slots, self.occupied, self.ends, self.counts = slots, occupied, ends, counts

    @classmethod
    def of(cls, fps: np.ndarray, number: np.ndarray, bits: int) -> Filter:
        """From sorted distinct fingerprints and how often each occurs."""
        q = min(bits - 1, int(len(fps) / 0.9).bit_length())
        r = bits - q
        quotient = (fps >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(len(fps), np.int64)
        step, mask = min(r, 62), np.uint64((1 << r) - 1)
        # a count c of 2 or more is c - 2 in digits of a remainder's size
        rest, digits = number - 2, np.zeros(len(fps), np.int64)
        while (more := rest >= 0).any():
            digits[more] += 1
            rest = np.where(rest >> step > 0, rest >> step, -1)
        size = 1 + digits
        before = np.cumsum(size) - size
        at = before + np.maximum.accumulate(quotient - before) if len(fps) else before
        total = max(1 << q, int(at[-1] + size[-1]) if len(fps) else 1)
        slots, occupied, ends, counts = np.zeros(total, np.uint64), np.zeros(1 << q, bool), np.zeros(total, bool), np.zeros(total, bool)
        slots[at] = fps & mask
        rest = np.maximum(number - 2, 0)
        for d in range(int(digits.max(initial=0))):
            on = digits > d
            slots[at[on] + 1 + d] = rest[on].astype(np.uint64) & np.uint64((1 << step) - 1)
            counts[at[on] + 1 + d] = True
            rest = rest >> step
        occupied[quotient] = True
        last = np.append(quotient[1:] != quotient[:-1], True) if len(fps) else np.zeros(0, bool)
        ends[(at + digits)[last]] = True
        return cls(bits, q, slots, occupied, ends, counts)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotient, first slot and last slot of each run: the k-th occupied quotient owns the k-th run."""
        quotient, last = np.flatnonzero(self.occupied), np.flatnonzero(self.ends)
        return quotient, np.maximum(quotient, np.concatenate([[0], last[:-1] + 1])), last

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and how often each occurs."""
        quotient, first, last = self._runs()
        size = last - first + 1
        used = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        digit, value = self.counts[used], self.slots[used]
        place = np.flatnonzero(~digit)
        own = np.repeat(quotient, size)[place].astype(np.uint64)
        fps = value[place] | (own << np.uint64(self.r) if self.r < 64 else np.uint64(0))
        number = np.ones(len(place), np.int64)
        of = np.cumsum(~digit) - 1
        extra = np.flatnonzero(digit)
        if len(extra):
            nth = extra - place[of[extra]] - 1
            np.add.at(number, of[extra], (value[extra] << (nth * min(self.r, 62)).astype(np.uint64)).astype(np.int64))
            number[np.unique(of[extra])] += 1
        return fps, number

    def holds(self, fps: np.ndarray) -> np.ndarray:
        """Which of the fingerprints are in: each looks through the run of its quotient."""
        out = np.zeros(len(fps), bool)
        _, first, last = self._runs()
        if not len(first):
            return out
        quotient = (fps >> np.uint64(self.r)).astype(np.int64) if self.r < 64 else np.zeros(len(fps), np.int64)
        which = np.flatnonzero(self.occupied[quotient])
        run = (np.cumsum(self.occupied) - 1)[quotient[which]]
        at, end = first[run], last[run]
        want = fps[which] & np.uint64((1 << self.r) - 1)
        while len(which):
            same = (self.slots[at] == want) & ~self.counts[at]
            out[which[same]] = True
            go = ~same & (at < end)
            which, at, end, want = which[go], at[go] + 1, end[go], want[go]
        return out

    def merged(self, other: Filter) -> Filter:
        """The filter of both, by one walk over the sorted runs of each."""
        (x, n), (y, m) = self.entries(), other.entries()
        at = np.searchsorted(x, y)  # where y's entries go between x's
        both = np.zeros(len(y), bool)
        inside = at < len(x)
        both[inside] = x[at[inside]] == y[inside]
        n = n.copy()
        n[at[both]] += m[both]
        new = ~both
        return Filter.of(np.insert(x, at[new], y[new]), np.insert(n, at[new], m[new]), self.bits)

    def packed(self) -> bytes:
        """Four numbers, the slots with r bits each, and the three kinds of flags."""
        flat = np.unpackbits(self.slots.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=self.r, bitorder="little")
        return np.array([self.bits, self.q, len(self.slots)], np.int64).tobytes() + b"".join(map(_bits, (flat, self.occupied, self.ends, self.counts)))

    @classmethod
    def unpacked(cls, raw: bytes) -> Filter:
        bits, q, total = np.frombuffer(raw, np.int64, 3).tolist()
        at, flags = 24, []
        for n in (total * (bits - q), 1 << q, total, total):
            size = -(-n // 8)
            flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n, bitorder="little"))
            at += size
        wide = np.zeros((total, 64), np.uint8)
        wide[:, : bits - q] = flags[0].reshape(total, bits - q)
        return cls(bits, q, np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64), *(x.astype(bool) for x in flags[1:]))


def counted(fps: np.ndarray, bits: int) -> Filter:
    """The filter of fingerprints in any order."""
    return Filter.of(*np.unique(fps, return_counts=True), bits)


def merged(filters: Iterable[Filter]) -> Filter:
    """All filters as one: like sizes are merged first."""
    held: list[Filter] = []
    for f in filters:
        while held and len(held[-1].slots) <= 2 * len(f.slots):
            f = held.pop().merged(f)
        held.append(f)
    out = held.pop()
    while held:
        out = held.pop().merged(out)
    return out


def _fingerprint(low: bytes) -> int:
    return xxhash.xxh3_64_intdigest(low)


def fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """docs with fp (64 bits) and text_sha256 of the normalised text."""

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        fps, shas = [], []
        for value in batch.column(text):
            low = _lowered(value.as_py())
            fps.append(_fingerprint(low))
            shas.append(hashlib.sha256(low).hexdigest())
        return [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(shas)]

    return mapped(docs, step, [T.StructField("fp", T.LongType()), T.StructField("text_sha256", T.StringType())])


def repeated(fps: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(fp, n): the fingerprints (their leading `bits` bits) that occur more than once in fps (fp of 64 bits)."""
    low = bits - range_bits

    def build(batches):
        def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            seen = np.concatenate(held) >> np.uint64(64 - bits)
            seen.sort()
            part = (seen >> np.uint64(low)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            mask = np.uint64((1 << low) - 1)
            raw = [counted(seen[a:b] & mask, low).packed() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(raw, pa.binary())], names=["part", "filter"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(np.asarray(b.column(0)).view(np.uint64))
                size += b.num_rows
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def merge(batches):
        def told(part: int, whole: Filter) -> pa.RecordBatch:
            found, n = whole.entries()
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array((found[many] | np.uint64(part << low)).view(np.int64)), pa.array(n[many])], names=["fp", "n"])

        now, whole = None, []
        for b in batches:
            for part, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if whole:
                        yield told(now, merged(whole))
                    now, whole = part, []
                whole.append(Filter.unpacked(raw))
                if len(whole) >= 64:
                    whole = [merged(whole)]
        if whole:
            yield told(now, merged(whole))
        hand_back()

    filters = fps.select("fp").mapInArrow(build, "part long, filter binary")
    return filters.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(merge, "fp long, n long")


def _suspects(docs: DataFrame, many: DataFrame, bits: int, rows: int, most_sent: int) -> DataFrame:
    """(id, low) of the rows of docs (id, text) whose fingerprint is repeated, and perhaps a few more."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    number = many.count()
    shift = np.uint64(64 - bits)
    if number <= most_sent:
        found = np.sort(np.array([r.fp for r in many.select("fp").collect()], np.int64).view(np.uint64))
        shared = docs.sparkSession.sparkContext.broadcast(Filter.of(found, np.ones(len(found), np.int64), bits).packed())
        opened: list[Filter] = []

        def run(batches):
            if not opened:
                opened.append(Filter.unpacked(shared.value))
            for batch in batches:
                fps = np.array([_fingerprint(_lowered(x.as_py())) for x in batch.column("text")], np.uint64)
                keep = pa.array(opened[0].holds(fps >> shift))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], schema=batch.schema)
            hand_back()

        return docs.mapInArrow(run, docs.schema).select("id", lower.alias("low"))

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        fps = np.array([_fingerprint(_lowered(x.as_py())) for x in batch.column("text")], np.uint64)
        return [pa.array((fps >> shift).view(np.int64))]

    named = mapped(docs, step, [T.StructField("fp", T.LongType())])
    return hot_join(named, many, ["fp"], "n", rows).select("id", lower.alias("low"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", fp_bits: int | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256. fp_bits: None for what the row count asks for."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    ids = written(fingerprints(docs, "text").drop("text"), "fingerprints")
    rows = ids.count()
    bits = fp_bits or min(64, max(32, rows.bit_length() + 24))
    range_bits = min(bits - 1, max(LEAST_RANGE_BITS, (rows // RANGE_ROWS).bit_length()))
    many = written(repeated(ids, bits, range_bits), "repeated")
    texts = _suspects(docs, many, bits, rows, most_sent)
    # byte verification
    groups = texts.groupBy("low").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = written(groups.select(F.sha2(F.col("low").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    out = hot_join(ids, groups, ["text_sha256"], "group_size", rows, "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(key), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: see the contract; one row per document."""
    return deduplicated(read(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY low) AS kept, sha256(low) AS text_sha256
FROM t
"""
