"""Language-model scores by a weighted backoff automaton.

Tokens are words with A-Z lower-cased, and one end per text. The automaton's states are the empty history
and the histories u of one word of the training texts: all of them, whatever the corpus' size (`frequent` can
ask for words with at least that share of the training tokens instead). From u an arc leads on each such word
v that followed u in training, weighted log10((c(u, v) - D) / c(u)); a failure arc, weighted log10 of u's
backoff, leads to the empty history, whose arcs carry log10((c(v) - d) / N). D and d are absolute discounts
n1 / (n1 + 2 * n2) of the counts. The mass d * V / N that the V known words leave is shared among the U words never
met: U is the estimate n1^2 / (2 * n2) of their number, or d * V / (1 - d) if that is more, so that no unknown
word is likelier than one met once. Backoffs make each state's probabilities add up to one over known and unknown
words. A text is read left to right: the state is carried along and weights are added up.

All counts cover all training texts. Neither the counts nor the automaton fit in one place at scale, so the
corpus is read in blocks of `block_bytes` of text (named by the file and offset they stand at, the same in
every pass). A block asks for the counts of the words and pairs in it, each summed once for all blocks, and
gets them back in the order of its own: the part of the automaton that its texts can visit. One task then
scores a block; what is left open are failure arcs from histories that other blocks have too. Each pair's
share of its history's backoff is counted by one block; the shares are added up by history, and the backoffs
joined to the texts that need them. Counts travel as arrays. Only a few totals reach the driver.

Words and pairs are named by 64-bit hashes. Null and empty texts are one end token. Repeated rows count as
often as they stand. Rows with a null id train. A text is scored whole, in one block, whatever its length. Ids may be
of any type and other columns are not read. Rows that come from no file are written to one first. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import NON_SPACE, chunks, hand_back, mix, read, word_hashes, written

END = np.uint64(0x1B873593CC9E2D51)
#: Counts of words and of pairs are dealt out by this many leading bits of their hashes.
_WORD_BITS, _PAIR_BITS = 10, 12
#: Histories with this share of training tokens go to the failure arcs by broadcast (so at most 10,000 do).
_HOT = 1e-4
_LARGE = (1 << 14) - 1
#: Counts of whole buckets that are summed together.
HELD = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _placed(docs: DataFrame, key: str, text: str, test: Column) -> DataFrame:
    """(id, text, test, place): place names the input block."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), test.alias("test"))
    if not rows.filter(F.input_file_name() == "").isEmpty():
        rows = written(rows, "texts")
    return rows.withColumn("place", F.xxhash64(F.input_file_name(), F.input_file_block_start()))


class _Blocks:
    """Names the block of each row: its place, and a number that grows with the bytes read at that place."""

    def __init__(self, size: int):
        self.size, self.done = size, {}

    def names(self, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.uint64)
        for p in np.unique(place):
            mine = place == p
            ends = self.done.get(p, 0) + np.cumsum(sizes[mine])
            self.done[p] = int(ends[-1])
            out[mine] = mix(place[mine].view(np.uint64) + ((ends - sizes[mine]) // self.size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64)


def _named(df: DataFrame, size: int) -> DataFrame:
    """df with block for place."""

    def run(batches):
        blocks = _Blocks(size)
        for b in batches:
            if b.num_rows:
                sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), b.column("test"), pa.array(blocks.names(np.asarray(b.column("place")), sizes))], names=["id", "text", "test", "block"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, text string, test boolean, block long")


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the first of each row (len+1)."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, at in chunks(column):
        _, _, first, h = word_hashes(data, at, NON_SPACE)
        n = np.diff(first)
        own = np.full(len(h) + len(n), END)
        own[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        hashes.append(own)
        counts.append(n + 1)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _summed(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(h, return_inverse=True)
    return found, np.bincount(place, weight, len(found)).astype(np.int64)


def _inner(first: np.ndarray) -> np.ndarray:
    """Places of tokens that have one before them in their text."""
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    return np.flatnonzero(inner)


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + mix(v))


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values, cut."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
    return np.append(np.flatnonzero(new), len(new))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _counts(docs: DataFrame, size: int, pairs: bool = False, frequent=None) -> DataFrame:
    """(block, bucket, h, n): training counts of the words (or pairs, or pairs of frequent words) of each block; 0 for those only asked for.

    Of h the lower seven bytes are kept; bucket has the other."""
    bits = _PAIR_BITS if pairs else _WORD_BITS

    def run(batches):
        blocks = _Blocks(size)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def flush():
            if held:
                h, n = _summed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                held.clear()
                bucket = _bucket(h, bits)
                cuts = _cuts(bucket)
                low = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).ravel()
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, now, np.int64)), pa.array(bucket[cuts[:-1]]), _packed(low, cuts * 7), _packed(n.astype(np.int32), cuts)], names=["block", "bucket", "h", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0)).astype(np.int64)
            names = blocks.names(np.asarray(b.column("place")), sizes)
            train = ~np.asarray(b.column("test"))
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if names[lo] != now:
                    if (out := flush()) is not None:
                        yield out
                    now = int(names[lo])
                h, first = _tokens(b.column("text").slice(lo, hi - lo))
                weight = np.repeat(train[lo:hi], np.diff(first)).astype(np.int64)
                if pairs:
                    on = _inner(first)
                    if frequent is not None:
                        known = np.isin(h, frequent.value)
                        on = on[known[on] & known[on - 1]]
                    h, weight = _pair(h[on - 1], h[on]), weight[on]
                held.append(_summed(h, weight))
        if (out := flush()) is not None:
            yield out
        hand_back()

    return docs.mapInArrow(run, "block long, bucket int, h binary, n binary").repartition("bucket").sortWithinPartitions("bucket")


def _totals(counts: DataFrame, bits: int, named: bool) -> DataFrame:
    """(block, bucket, check, code, large, h): to each block the sums over all blocks of what it has, in the order of h.

    A code is 4 * sum, + 2 where other blocks may have it too, + 1 in one block of each h; sums from _LARGE on stand in large.
    check is a digest of the hashes, which are given only if named. Rows without a block hold the sum and number of all
    that were counted in training, and the numbers of ones and twos."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size, last = 0, None
        for b in batches:
            # buckets come in order: those that are whole are summed once there are enough of them
            buckets = np.asarray(b.column("bucket"))
            cuts = _cuts(buckets) if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= HELD and buckets[lo] != last:
                    yield from told(held)
                    held, size = [], 0
                last = buckets[lo]
                part = b.slice(lo, hi - lo)
                lengths = np.asarray(pa.compute.binary_length(part.column("n"))) // 4
                h = np.zeros((int(lengths.sum()), 8), np.uint8)
                h[:, :7] = _unpacked(part.column("h"), np.uint8).reshape(-1, 7)
                h[:, 7] = last >> (bits - 8)
                held.append((h.view(np.uint64).ravel(), np.repeat(np.asarray(part.column("block")), lengths), _unpacked(part.column("n"), np.int32)))
                size += len(h)
        if held:
            yield from told(held)
        hand_back()

    def told(held: list[tuple[np.ndarray, ...]]):
        h, block, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((block, h))
        h, block, n = h[order], block[order], n[order].astype(np.int64)
        cuts = _cuts(h)
        size, total = np.diff(cuts), np.add.reduceat(n, cuts[:-1]) if len(h) else n
        counted = total[total > 0]
        stats = [int(counted.sum()), len(counted), int((counted == 1).sum()), int((counted == 2).sum())]
        code = np.minimum(total, _LARGE) * 4 + (size > 1) * 2
        code, total = np.repeat(code, size), np.repeat(total, size)
        code[cuts[:-1]] += 1
        once = np.flatnonzero((code & 1 > 0) | np.concatenate([np.ones(min(1, len(h)), bool), block[1:] != block[:-1]]))
        once = once[np.argsort(block[once], kind="stable")]
        h, block, code, total = h[once], block[once], code[once].astype(np.uint16), total[once]
        bucket = _bucket(h, bits)
        cuts = _cuts(block, bucket)
        at = cuts[:-1]
        large = total >= _LARGE
        rows = {"block": block[at], "bucket": bucket[at], "check": np.bitwise_xor.reduceat(h, at).view(np.int64) if len(h) else h.view(np.int64), "code": _packed(code, cuts), "large": _packed(total[large], np.concatenate([[0], np.cumsum(large)])[cuts])}
        if named:
            rows["h"] = _packed(h, cuts)
        yield from pa.concat_tables([schema.empty_table(), pa.table(rows), pa.table({k: pa.array([x], pa.int64()) for k, x in zip(("size", "known", "ones", "twos"), stats, strict=True)})], promote_options="default").to_batches()

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("check", pa.int64()), ("code", pa.binary()), ("large", pa.binary()), ("h", pa.binary()), *((k, pa.int64()) for k in ("size", "known", "ones", "twos"))])
    return counts.mapInArrow(run, "block long, bucket int, check long, code binary, large binary, h binary, size long, known long, ones long, twos long")


def _sums(code: np.ndarray, large: np.ndarray) -> np.ndarray:
    total = (code >> 2).astype(np.int64)
    total[total == _LARGE] = large
    return total


def _frequent(words: DataFrame, least: float) -> np.ndarray:
    """The words with that many tokens."""

    def run(batches):
        for b in batches:
            h, code = _unpacked(b.column("h"), np.int64), _unpacked(b.column("code"), np.uint16)
            total = _sums(code, _unpacked(b.column("large"), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h[(code & 1 > 0) & (total >= least)])], names=["h"])

    return np.array([r.h for r in words.filter("block is not null").mapInArrow(run, "h long").collect()], np.int64).view(np.uint64)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def unmet_words(known: int, ones: int, twos: int, d: float) -> float:
    """How many words share the mass of unknown ones: Chao's estimate, or as many as leave none of them likelier than a known word."""
    return max(1.0, ones * ones / (2 * max(1, twos)), d * known / (1 - d))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", test: Column | None = None, frequent: float = 0, block_bytes: int = 8 << 20) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    sc = docs.sparkSession.sparkContext
    rows = _placed(docs, key, text, held_out(F.col(key)) if test is None else test)
    stats = lambda df: (x or 0 for x in df.agg(*map(F.sum, ("size", "known", "ones", "twos"))).first())
    words = written(_totals(_counts(rows, block_bytes), _WORD_BITS, frequent > 0), "words")
    size, known, ones, twos = stats(words)
    d, least = _discount(ones, twos), max(1, frequent * size)
    unmet = unmet_words(known, ones, twos, d)
    names = sc.broadcast(_frequent(words, least)) if frequent > 0 else None  # at most 1 / frequent
    pairs = written(_totals(_counts(rows, block_bytes, True, names), _PAIR_BITS, False), "pairs")
    _, _, ones, twos = stats(pairs)
    big = _discount(ones, twos)
    told = lambda df, pair: df.filter("block is not null").select("block", "bucket", "check", "code", "large", F.lit(pair).alias("pair"))
    asked = told(words, False).unionAll(told(pairs, True))
    out_schema = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("block", pa.int64()), ("row", pa.int64()), ("u", pa.int64()), ("times", pa.int64()), ("count", pa.int64()), ("mass", pa.float64()), ("p", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if not left.num_rows:
            return out_schema.empty_table()
        test = left["test"].to_numpy()
        h, first = _tokens(left["text"])

        def counted(found: np.ndarray, asked: np.ndarray, pair: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Training counts in all blocks, whether other blocks may have it, and whether this block counts it for all."""
            mine = right.filter(pa.compute.equal(right["pair"], pair)).sort_by("bucket")
            own, bits = found[asked], _PAIR_BITS if pair else _WORD_BITS
            bucket = _bucket(own, bits)
            at = _cuts(bucket)[:-1]
            if mine.num_rows != len(at) or len(at) and ((mine["bucket"].to_numpy() != bucket[at]) | (mine["check"].to_numpy().view(np.uint64) != np.bitwise_xor.reduceat(own, at))).any():
                raise ValueError("the blocks of this pass aren't those that asked for counts")
            code = _unpacked(mine["code"], np.uint16)
            n, far, leads = np.zeros(len(found), np.int64), np.zeros(len(found), bool), np.zeros(len(found), bool)
            n[asked], far[asked], leads[asked] = _sums(code, _unpacked(mine["large"], np.int64)), code & 2 > 0, code & 1 > 0
            return n, far, leads

        word, at = np.unique(h, return_inverse=True)
        count, far, _ = counted(word, np.ones(len(word), bool), False)
        p = np.where(count > 0, count - d, d * known / unmet) / size if size else (count + 1) / (size + known + 1)
        on = _inner(first)
        pair, one, which = np.unique(_pair(h[on - 1], h[on]), return_index=True, return_inverse=True)
        u, v = at[on[one] - 1], at[on[one]]
        n, _, leads = counted(pair, (count[u] >= least) & (count[v] >= least) if frequent > 0 else np.ones(len(pair), bool), True)
        arc = n > 0
        mine = arc & leads
        mass, left_p = (np.bincount(u[mine], x, len(word)).astype(float) for x in (n[mine] - big, p[v[mine]]))
        back = np.where(far, 0, np.log10(np.maximum(1e-12, 1 - mass / np.maximum(1, count)) / np.maximum(1e-12, 1 - left_p)))
        weight = np.log10(p)[at]
        weight[on] += back[at[on - 1]]  # through the failure arc
        taken = arc[which]
        weight[on[taken]] = np.log10((n[which[taken]] - big) / count[at[on[taken] - 1]])
        row = np.repeat(np.arange(len(test)), np.diff(first))
        failed = on[~taken & far[at[on - 1]] & (count[at[on - 1]] >= least)]
        open_, times = np.unique(row[failed] * len(word) + at[failed - 1], return_counts=True)
        shared = np.flatnonzero(far & (mass > 0))
        c, ends = count[at], first[:-1]
        base = np.log10((c + 1) / (size + known + 1))
        block = left["block"][0].as_py()
        scores = {"id": left["id"], "held_out": pa.array(test), "n_tokens": np.diff(first), "n_known": np.add.reduceat((c > 0).astype(np.int64), ends), "train_tokens": np.full(len(test), size), "base_score": np.add.reduceat(base, ends), "score": np.add.reduceat(weight, ends), "block": np.full(len(test), block), "row": np.arange(len(test))}
        failures = {"block": np.full(len(open_), block), "row": open_ // len(word), "u": word[open_ % len(word)].view(np.int64), "times": times}
        shares = {"u": word[shared].view(np.int64), "count": count[shared].astype(np.int64), "mass": mass[shared], "p": left_p[shared]}
        hand_back()
        return pa.concat_tables([out_schema.empty_table(), *map(pa.table, (scores, failures, shares))], promote_options="default")

    texts = _named(rows, block_bytes)
    sql_type = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", out_schema[0].type: rows.schema["id"].dataType.simpleString()}
    done = written(texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, ", ".join(f"{x.name} {sql_type[x.type]}" for x in out_schema)), "scores")
    left = F.log10(F.greatest(F.lit(1e-12), 1 - F.sum("mass") / F.max("count")) / F.greatest(F.lit(1e-12), 1 - F.sum("p")))
    backs = done.filter("mass is not null").groupBy("u").agg(left.alias("back"), (F.max("count") >= _HOT * size).alias("hot"))
    failures = done.filter("times is not null").select("block", "row", "u", "times")
    hot = F.broadcast(backs.filter("hot").drop("hot"))
    met = failures.join(hot, "u").unionByName(failures.join(hot.select("u"), "u", "left_anti").join(backs.filter("not hot").drop("hot"), "u"))
    gaps = met.groupBy("block", "row").agg(F.sum(F.col("times") * F.col("back")).alias("gap"))
    out = done.filter("n_tokens is not null").join(gaps, ["block", "row"], "left")
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("score") + F.coalesce("gap", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: see the contract; one row per document."""
    return scored(read(spark, sf_dir, "documents"))
