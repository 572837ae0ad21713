"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words and of their first
four and five bytes, which inflected forms share (hashed to 2^18 weights); a document's is the noisy-or of its
sentences: 1 - prod(1 - score). Only document labels are needed to fit the weights, by gradient ascent on the likelihood of the noisy-or; afterwards the sentence scores tell
which sentences offend (offending()).

Fitting uses at most `most_rows` labelled documents of each class (parameter, default 2000), chosen by a hash of the id,
of at most `most_bytes` bytes (default 1 MB) each and `most_total` bytes (default 32 MB) a class; scoring covers every
document and its whole text. Labels: null labels and ids are left out, of repeated ones the largest counts. Of
documents with one labelled id one text is fitted on (the one with the least digest). Empty and null texts get the score of no evidence (0 sentences: 0.0). Without labels
of both classes every weight is 0 and every score next to 0 (below 1e-9 for a text of ordinary length). Repeated rows
score alike. Other columns pass through; those with the names added here are replaced. An empty table gives an empty
table with the same columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, chunks, mapped, mix, prefix_hash, read, span_hash, words

BITS = 18
#: Bytes of a word that make a feature; None: all.
HEADS = (None, 4, 5)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words' features, the first of each sentence that has words, the first sentence of each row, and each sentence's first byte."""
    start, stop, first = words(data, at, ALNUM)
    sums = prefix_hash(data)
    slot = np.empty((len(start), len(HEADS)), np.int64)
    for k, size in enumerate(HEADS):
        h = span_hash(sums, start, stop if size is None else np.minimum(stop, start + size))
        slot[:, k] = mix(h + np.uint64(k)) >> np.uint64(64 - BITS)
    marks = np.cumsum(_ENDS[data]) if len(data) else np.zeros(0, np.int64)
    sentence = marks[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = sentence[1:] != sentence[:-1]
    new[first[:-1][first[:-1] < len(start)]] = True
    begins = np.flatnonzero(new)
    return slot.ravel(), begins * len(HEADS), np.searchsorted(begins, first), start[begins] if len(begins) else begins


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_scores(slot: np.ndarray, begins: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return _sigmoid(np.add.reduceat(weights[slot], begins) + bias) if len(begins) else np.zeros(0)


def noisy_or(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    logs = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(scores.astype(float), 1 - 1e-12)))])
    return 1 - np.exp(logs[first[1:]] - logs[first[:-1]])


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.1, decay: float = 1e-4, least_bags: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, slots, first word of each sentence) by Adam on the noisy-or likelihood."""
    weights, bias = np.zeros(1 << BITS), -4.0
    bags = [b for b in bags if len(b[1])]
    number = len(bags)
    labels = np.array([b[0] for b in bags], float)
    if len(set(labels.tolist())) < 2:
        return weights, -30.0
    sizes = np.array([len(b[1]) for b in bags])
    seen = np.zeros(1 << BITS, np.int64)
    for _, slot, _ in bags:
        seen[np.unique(slot)] += 1
    common = seen >= least_bags  # words of fewer bags keep the weight 0
    slots = np.concatenate([b[1] for b in bags]).astype(np.int32)
    begins = np.concatenate([b[2] + o for b, o in zip(bags, np.cumsum(sizes) - sizes, strict=True)])
    counts = np.array([len(b[2]) for b in bags])
    first = np.concatenate([[0], np.cumsum(counts)])
    bag = np.repeat(np.arange(len(bags)), counts)
    length = np.diff(np.append(begins, len(slots)))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    w, m, v = (np.zeros(len(weights) + 1) for _ in range(3))
    del bags[:]  # their slots are in one array now
    w[-1] = bias
    for t in range(1, rounds + 1):
        s = _sigmoid(np.add.reduceat(w.astype(np.float32)[slots], begins) + w[-1])
        p = np.clip(noisy_or(s, first), 1e-9, 1 - 1e-9)
        # d log L / d x_i of a sentence: s_i * (y / p - 1), as d p / d x_i = (1 - p) * s_i
        g = s * (labels / p - 1)[bag] * weight[bag]
        grad = np.append(np.bincount(slots, np.repeat(g.astype(np.float32), length), len(weights)), g.sum()) / number - decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        m[:-1] *= common
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def trained(docs: DataFrame, labels: DataFrame, usable: Column, most_rows: int = 2000, most_bytes: int = 1 << 20, most_total: int = 32 << 20) -> tuple[np.ndarray, float]:
    """Fit on labelled documents for which usable (an expression over doc_id) holds."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).withColumn("nth", F.xxhash64("doc_id")) for y in (0, 1)]
    chosen = parts[0].unionAll(parts[1])  # 2 * most_rows rows at most: small enough to send to every task
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= most_bytes)
    sizes = texts.groupBy("toxic", "nth", "doc_id").agg(F.min(F.struct(F.md5("text").alias("digest"), F.octet_length("text").alias("size"))).alias("x")).select("toxic", "nth", "doc_id", "x.*").collect()
    held, total = [], [0, 0]
    for r in sorted(sizes):
        if total[r.toxic] + r["size"] <= most_total:
            total[r.toxic] += r["size"]
            held.append((r.doc_id, r.toxic, r.digest))
    names = docs.sparkSession.createDataFrame(held, docs.select("doc_id").schema.add("toxic", T.IntegerType()).add("digest", T.StringType()))
    texts = docs.select("doc_id", "text", F.md5("text").alias("digest")).join(F.broadcast(names), ["doc_id", "digest"]).dropDuplicates(["doc_id"])

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        slots, begins = [], []
        for _, data, at in chunks(batch.column("text"), 1):
            s, b, _, _ = features(data, at)
            slots.append(s.astype(np.int32).tobytes())
            begins.append(b.astype(np.int32).tobytes())
        return [pa.array(slots, pa.binary()), pa.array(begins, pa.binary())]

    made = mapped(texts, step, [T.StructField("slots", T.BinaryType()), T.StructField("begins", T.BinaryType())]).select("doc_id", "toxic", "slots", "begins")
    return fit([(r.toxic, np.frombuffer(r.slots, np.int32), np.frombuffer(r.begins, np.int32).astype(np.int64)) for r in sorted(made.collect())])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        weights, bias = shared.value
        out = [np.zeros(0)]
        for _, data, at in chunks(batch.column(text)):
            slot, begins, first, _ = features(data, at)
            out.append(noisy_or(sentence_scores(slot, begins, weights, bias), first))
        return [pa.array(np.clip(np.concatenate(out), 0, 1), pa.float64())]

    return mapped(docs, step, [T.StructField("score", T.DoubleType())])


def offending(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with offending_sentences: those that score `least` or more, with their first byte and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType())]))

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        weights, bias = shared.value
        out = []
        for _, data, at in chunks(batch.column(text), 1):
            slot, begins, _, place = features(data, at)
            s = sentence_scores(slot, begins, weights, bias)
            stop = np.append(place[1:], len(data))
            out.append([{"start": int(place[i]), "score": float(s[i]), "sentence": data[place[i] : stop[i]].tobytes().decode("utf-8", "replace")} for i in np.flatnonzero(s >= least)])
        return [pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())])))]

    return mapped(docs, step, [T.StructField("offending_sentences", kind)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted, trained on the labelled rows that are not held out."""
    out = scored(docs, trained(docs, labels, ~held_out(F.col("doc_id"))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: see the contract; one row per document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = predicted(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
