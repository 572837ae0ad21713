"""Near duplicates by an exact Jaccard self-join over word shingles, through parity sketches.

A document's set holds the hashes of its distinct shingles. The sketch is a bit vector in which every shingle
flips one bit; sketches of two sets therefore differ in at most |A xor B| bits, and a similarity of t leaves
at most (1 - t) / (1 + t) * (|A| + |B|) of them. The vector is cut into k blocks, of which at most as many can
differ; of the others, equal in both, one joins the pair (pigeonhole). Size bands fix k: sets of 64 * 4^i
shingles or so share a band, and a set near the lower edge also joins the band below. A block's value is represented by the xor of its flipped bits'
fingerprints, so equal blocks always agree and the rest practically never do.

A set sends the first d + 1 + s of its blocks in one global order (by hash, empty ones last), where d bounds
the differing blocks and s is slack. Any two similar sets then have s + 1 such blocks in common. Blocks that
more than HOT sets share are set aside; a set with more of them than the slack allows is `unsafe`. A pair
with a set that isn't is found in a block that few share. Pairs of unsafe sets (large families of near
copies, texts made of common lines) are found by their rarest shingles among the unsafe (prefix filter, with
the bound that the shingles' places give).

Candidates that the sizes rule out, or whole sketch vectors by their Hamming distance, go. Verification counts
the true intersection of the others. Documents with equal sets form one class first. Every class is
checked against one candidate first, the most common-place one (of a family, the text that the others vary);
then only candidates that lie in different components are checked, so a family of m near copies takes about
m checks and yet no link is lost.

near_duplicates() gives components, near_pairs() the links themselves, between one row of each class.

Empty and null texts have an empty set and no link. Rows with a null id link nothing. Repeated rows fall into
one class; a row is known by its id and the digest of its text, so rows that share an id but not the text are judged
each by its own text. A text is read whole, whatever its length. Other columns are not read, but those named in
`carry` pass through. Ids may be of any type that has an order. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .text import NON_SPACE, chunks, hand_back, hot_join, mapped, mix, read, word_hashes, written

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_EMPTY = np.uint64(0xE7037ED1A0B428DB)
#: Sets in a block beyond which it is set aside.
HOT = 8
#: Rounds in which unsafe sets are compared with the most common-place set of their block alone.
HUB_ROUNDS = 2
#: The band of small sets ends here; each further band is four times as wide.
SMALL = 64


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    _, _, first, h = word_hashes(data, at, NON_SPACE)
    n = np.diff(first)
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            s += h[j : len(s) + j] * (_K[j % 5] + np.uint64(2 * (j // 5)))
        s = mix(s)
    out = []
    for i, k in enumerate(n.tolist()):
        a = int(first[i])
        if k >= size:
            out.append(np.unique(s[a : a + k - size + 1]))
        elif k:
            whole = np.array([k], np.uint64)
            for x in h[a : a + k]:
                whole = mix(whole * _K[0] + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(tokens):
        return 0
    a, b = np.bitwise_xor.reduce(mix(tokens + _K[1]), keepdims=True), np.add.reduce(mix(tokens ^ _K[2]), keepdims=True)
    return int(mix(a * _K[0] + b + np.uint64(len(tokens)))[0])


class Sketch:
    """How sets of a size become block signatures for a similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differ(self, n: int) -> int:
        """The most that a similar set of any size can differ: (1 - t) / t of n."""
        return n * (self.den - self.num) // self.num

    def slack(self, n: int) -> int:
        return n // 10 + 2

    def bands(self, n: int) -> list[int]:
        band = 0
        while n >= SMALL << (2 * band):
            band += 1
        edge = SMALL << (2 * (band - 1)) if band else 0
        return [band, band - 1] if band and n * self.num < edge * self.den else [band]

    def blocks(self, band: int) -> int:
        return (SMALL << (2 * band)) * 2 // 3

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not self.differ(n) and n:
            return np.zeros(0, np.uint64)  # only an equal set is similar
        take = self.differ(n) + 1 + self.slack(n)
        out = []
        for band in self.bands(n):
            salt = np.uint64((band + 1) * int(_K[3]) % (1 << 64))
            bits = mix(tokens ^ salt)
            k = self.blocks(band)
            block = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            sig = mix(np.bitwise_xor.reduceat(bits, at) + block[at] * _K[4] + salt)
            if len(sig) < take:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), block[at])
                sig = np.concatenate([sig, np.sort(mix(empty * _K[4] + salt + _EMPTY))[: take - len(sig)]])
            out.append(np.partition(sig, take - 1)[:take] if len(sig) > take else sig)
        return np.concatenate(out)

    def vector(self, tokens: np.ndarray) -> bytes:
        """The sketch as one vector of at least as many bits as tokens (a power of two), for a last look at a pair."""
        bits = max(64, 1 << max(0, len(tokens) - 1).bit_length())
        place = (mix(tokens ^ _K[4]) & np.uint64(bits - 1)).astype(np.int64)
        return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()

    def may_link(self, n: int, m: int, x: bytes, y: bytes) -> bool:
        """False if sizes or sketches rule a link out. A longer vector folds to a shorter by xor of its halves."""
        if self.num * max(n, m) > self.den * min(n, m):
            return False
        size = min(len(x), len(y))
        a, b = (int.from_bytes(v, "little") for v in (x, y))
        for v, other in ((len(x), "a"), (len(y), "b")):
            while v > size:
                v //= 2
                low = (1 << (8 * v)) - 1
                if other == "a":
                    a = (a & low) ^ (a >> (8 * v))
                else:
                    b = (b & low) ^ (b >> (8 * v))
        return (a ^ b).bit_count() * (self.den + self.num) <= (self.den - self.num) * (n + m)


def _i64(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def document_sets(docs: DataFrame, size: int, sketch: Sketch) -> DataFrame:
    """docs (id, text, row and others) with n, key and vector for text."""

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [s for _, data, at in chunks(batch.column("text")) for s in shingle_sets(data, at, size)]
        return [pa.array([len(s) for s in sets], pa.int64()), _i64([set_key(s) for s in sets]), pa.array([sketch.vector(s) for s in sets], pa.binary())]

    return mapped(docs, step, [T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("vector", T.BinaryType())]).drop("text")


def _signatures(docs: DataFrame, size: int, sketch: Sketch) -> DataFrame:
    """(sig, key) of docs (id, text); within a task equal sets send theirs once."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            for _, data, at in chunks(batch.column("text")):
                sigs, keys = [], []
                for tokens in shingle_sets(data, at, size):
                    key = set_key(tokens)
                    if len(tokens) and key not in done:
                        done.add(key)
                        sigs.append(sketch.signatures(tokens))
                        keys.append(np.full(len(sigs[-1]), key, np.uint64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([_i64(np.concatenate(sigs)), _i64(np.concatenate(keys))], names=["sig", "key"])
        hand_back()

    return docs.select("text").mapInArrow(run, "sig long, key long")


def _buckets(batches):
    """(hot, x, y): candidate pairs x < y of blocks that few share, and (block, set) of those set aside."""
    held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not held:
        return
    sig, key = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(at, len(sig)))
    xs, ys = [], []
    for m in range(2, HOT + 1):
        rows = key[at[count == m][:, None] + np.arange(m)]
        for i in range(m):
            for j in range(i + 1, m):
                xs.append(rows[:, i])
                ys.append(rows[:, j])
    x, y = np.concatenate(xs), np.concatenate(ys)
    if len(x):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(new.sum(), bool)), pa.array(x[new]), pa.array(y[new])], names=["hot", "x", "y"])
    big = np.repeat(count > HOT, count)
    if big.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(big.sum(), bool)), pa.array(sig[big]), pa.array(key[big])], names=["hot", "x", "y"])
    del held, sig, key, order, new, xs, ys, x, y
    hand_back()


def _plausible(pairs: DataFrame, classes: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""
    sides = [classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"v_{x}")) for x in "ab"]
    fits = (F.col("n_a") * sketch.num <= F.col("n_b") * sketch.den) & (F.col("n_b") * sketch.num <= F.col("n_a") * sketch.den)
    # sizes first: they are narrow
    pairs = pairs.join(sides[0].drop("v_a"), "a").join(sides[1].drop("v_b"), "b").filter(fits)
    both = pairs.join(sides[0].drop("n_a"), "a").join(sides[1].drop("n_b"), "b")

    def run(batches):
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns[2:]]
            keep = pa.array([sketch.may_link(*x) for x in zip(*rows, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches):
        for batch in batches:
            keep = []
            last: tuple[int | None, np.ndarray | None] = (None, None)
            names = [batch.column(i).to_pylist() for i in (0, 1)]
            for i, (k, _) in enumerate(zip(*names, strict=True)):
                if last[0] != k:
                    last = (k, _one(batch.column(2)[i], size))
                other = _one(batch.column(3)[i], size)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                if den * common >= num * (len(last[1]) + len(other) - common):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _one(value: pa.Scalar, size: int) -> np.ndarray:
    data = np.frombuffer(value.as_py().encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)[0]


def _rarest(texts: DataFrame, size: int, sketch: Sketch) -> DataFrame:
    """(sig, key, n, nth, score): each set's rarest shingles among texts, as many as it can lack of a similar set's and
    one more, without those that no other has. nth: the place in the set by rarity; score: how common its shingles are."""

    def run(batches):
        for batch in batches:
            for row, data, at in chunks(batch.column("text")):
                sets = shingle_sets(data, at, size)
                n = np.array([len(s) for s in sets])
                key = np.asarray(batch.column("key"))[row : row + len(sets)]
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(sets)), pa.array(np.repeat(key, n)), pa.array(np.repeat(n, n), pa.int64())], names=["sig", "key", "n"])

    tokens = written(texts.select("key", "text").mapInArrow(run, "sig long, key long, n long"), "tokens")
    shared = tokens.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    of_set = Window.partitionBy("key")
    ranked = tokens.join(shared, "sig").withColumns({"nth": F.row_number().over(of_set.orderBy("df", "sig")), "score": F.avg(F.log("df")).over(of_set)})
    take = F.col("n") - F.ceil(F.col("n") * sketch.num / sketch.den) + 1
    return ranked.filter((F.col("nth") <= take) & (F.col("df") > 1)).select("sig", "key", "n", "nth", "score")


def _labelled(rare: DataFrame, roots: DataFrame | None, rows: int) -> DataFrame:
    """rare with root, without the blocks that lie in one component."""
    if roots is None:
        return rare.withColumn("root", F.col("key"))
    out = rare.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = out.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi").select("sig", "size")
    return hot_join(out, mixed, ["sig"], "size", rows).drop("size")


def _enough(sketch: Sketch) -> Column:
    """Whether sets that meet first at their nth shingles can still share enough: all later ones at most."""
    return (F.least(F.col("n") - F.col("nth"), F.col("m") - F.col("mth")) + 1) * (sketch.num + sketch.den) >= sketch.num * (F.col("n") + F.col("m"))


def _to_hubs(rare: DataFrame, roots: DataFrame | None, sketch: Sketch, number: int) -> DataFrame:
    """(a, b, score): each set with the most common-place set of its block, if that is of another component."""
    rows = _labelled(rare, roots, number)
    hub = rows.groupBy("sig").agg(F.max(F.struct("score", "key", "root", F.col("n").alias("m"), F.col("nth").alias("mth"))).alias("hub"), F.count(F.lit(1)).alias("size"))
    hub = hub.select("sig", F.col("hub.score").alias("s"), F.col("hub.key").alias("a"), F.col("hub.root").alias("other"), "hub.m", "hub.mth", "size")
    met = hot_join(rows, hub, ["sig"], "size", number).filter((F.col("root") != F.col("other")) & _enough(sketch))
    return met.select("a", F.col("key").alias("b"), F.col("s").alias("score"))


def _across(rare: DataFrame, roots: DataFrame, sketch: Sketch, rows: int) -> DataFrame:
    """Pairs (a, b) of rare in one block but in different components."""
    left = _labelled(rare, roots, rows).drop("score")
    right = left.select("sig", F.col("key").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("nth").alias("mth"))
    fits = (F.col("n") * sketch.num <= F.col("m") * sketch.den) & (F.col("m") * sketch.num <= F.col("n") * sketch.den)
    met = left.join(right, "sig").filter((F.col("key") < F.col("b")) & (F.col("root") != F.col("other")) & fits & _enough(sketch))
    return met.select(F.col("key").alias("a"), "b").distinct()


def _candidates(docs: DataFrame, words: int, sketch: Sketch) -> tuple[DataFrame, ...]:
    """(sets, classes, found, texts, rare) of docs (id, text, others).

    sets: docs with n, key and vector for text; classes (key, rep, row, n, vector): one row of each set; found (a, b): the
    plausible pairs of blocks that few share; texts (key, text) of those in found and of the unsafe; rare: see _rarest()."""
    num, den = sketch.num, sketch.den
    docs = docs.withColumn("row", F.unhex(F.md5("text")))
    sets = written(document_sets(docs, words, sketch), "sets")
    first = sets.filter("n > 0 and id is not null").groupBy("key").agg(F.min(F.struct("id", "row")).alias("rep"), F.first("n").alias("n"), F.first("vector").alias("vector"))
    classes = written(first.select("key", F.col("rep.id").alias("rep"), F.col("rep.row").alias("row"), "n", "vector"), "classes")
    blocks = written(_signatures(docs.filter("id is not null"), words, sketch).repartition("sig").mapInArrow(_buckets, "hot boolean, x long, y long"), "blocks")
    found = blocks.filter("not hot").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    hot = blocks.filter("hot").groupBy(F.col("y").alias("key")).agg(F.count(F.lit(1)).alias("hot"))
    # of the sizes a similar set can have, the smallest has the least slack
    least = F.floor(F.floor(F.col("n") * num / den) / 10) + 2
    unsafe = hot.join(classes, "key").filter(F.col("hot") > least).select("key")
    unsafe = written(unsafe, "unsafe")
    found = written(_plausible(found, classes, sketch), "found")
    needed = found.select(F.explode(F.array("a", "b")).alias("key")).unionAll(unsafe).distinct()
    ids = needed.join(classes, "key").select("key", F.col("rep").alias("id"), "row")
    # repeated rows have one text
    texts = written(docs.join(ids, ["id", "row"]).select("key", "text").dropDuplicates(["key"]), "texts")
    rare = written(_rarest(texts.join(unsafe, "key"), words, sketch), "rare")
    return sets, classes, found, texts, rare


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, (a, b) with a < b, and the members of each set, (key, class): a and b are classes.

    Every candidate is verified, so the work follows the number of links: a family of m different texts that are all
    alike has m * (m - 1) / 2 of them. near_duplicates() doesn't need them."""
    sketch = Sketch(num, den)
    sets, classes, found, texts, rare = _candidates(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), words, sketch)
    left = rare.drop("score")
    right = left.select("sig", F.col("key").alias("b"), F.col("n").alias("m"), F.col("nth").alias("mth"))
    met = left.join(right, "sig").filter((F.col("key") < F.col("b")) & _enough(sketch)).select(F.col("key").alias("a"), "b").distinct()
    pairs = _linked(found.unionAll(_plausible(met, classes, sketch)).distinct(), texts, words, num, den)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets.filter("n > 0 and id is not null").select(F.col("id").alias(key), F.col("key").alias("class"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row, and its columns named in carry."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    sketch = Sketch(num, den)
    sets, classes, found, texts, rare = _candidates(docs, words, sketch)
    number = rare.count()
    # one candidate for every set: the most common-place one, else the smallest
    star = _to_hubs(rare, None, sketch, number).unionAll(found.withColumn("score", F.lit(-1.0)))
    links, roots, tried = None, None, None
    for _ in range(HUB_ROUNDS):
        best = star.groupBy("b").agg(F.max(F.struct("score", "a")).alias("x")).select("x.a", "b")
        best = written(best, "first")
        tried = best if tried is None else tried.unionAll(best)
        new = written(_linked(best, texts, words, num, den), "verified")
        links = new if links is None else links.unionAll(new)
        roots = written(components(links), "roots")
        star = _to_hubs(rare, roots, sketch, number)
    label = lambda of, name: roots.select(F.col("v").alias(of), F.col("root").alias(name))
    apart = found.join(label("a", "ra"), "a", "left").join(label("b", "rb"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    rest = apart.unionAll(_plausible(_across(rare, roots, sketch, number), classes, sketch)).distinct()
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.join(tried, ["a", "b"], "left_anti")
    links = links.unionAll(written(_linked(rest, texts, words, num, den), "verified"))
    roots = written(components(links), "roots")
    named = classes.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(lowest, "root").select("key", "component_id")
    lowest_id = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return sets.join(labels, "key", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), lowest_id.alias("component_id"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: see the contract; one row per document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
