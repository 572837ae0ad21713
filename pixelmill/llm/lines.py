"""Removal of repeated runs of lines by a suffix array over line ids.

A line's id is its 128-bit digest; a text is the sequence of its lines (split at newlines). A run of whole
consecutive lines with at least `least_words` words (split at white space) that also stands earlier (in a text
with a smaller id, or earlier in the same text; overlaps count) is a later copy, and its lines are deleted.
The first copy stays. All is judged on the input, so the result doesn't depend on an order of deletions.

The suffixes of all line sequences are sorted by distributed prefix doubling. A suffix's rank for 2^k lines is its
place in the order of the first 2^k lines, and equal for those that share them; it comes from sorting the pairs
of ranks of both halves by ranges over the whole cluster (equal pairs are combined before, so a common line is one
row), with the sizes of all ranges before added up. Suffixes that tie with no other are settled and drop out; the
others stay in the array, as many levels as the longest run that is asked for needs. Suffixes that share their first m
lines are neighbours in the array: an interval of longest common prefixes of m lines or more. For 2^k <= m <
2^(k+1) it is known by its two ranks for 2^k lines: that of the suffix and that of the one m - 2^k lines on. Of each
interval that is long enough, all suffixes but the earliest are copies. It suffices to look at the least long
enough run from each line forwards and up to each line backwards: every longer repeated run is a union of such.
Adjacent deleted lines form the maximal repeated runs reported.

A text is known by a 64-bit digest of its own, and stands in the array once, under the smallest id that has it (null
ids come last); rows with the same text under other ids are later copies and go whole if they have enough words. Rows
with one id and one text count as one, and all of them stay if the first does. Rows that share an id but not the text
are ordered by the digest. Null and empty texts are one empty line and are never copies. Texts are read whole,
whatever their length; ids may be of any type that has an order; other columns pass through, and those with the names
added here are replaced. An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import hand_back, hot_join, mapped, read, written


def windows(words: np.ndarray, least: int) -> dict[int, set[int]]:
    """{first line: lengths} of the least runs with enough words, from each line forwards and up to each backwards."""
    sums = np.concatenate([[0], np.cumsum(words)])
    out: dict[int, set[int]] = {}
    line = np.arange(len(words))
    stop = np.searchsorted(sums, sums[:-1] + least, "left")
    for i in np.flatnonzero(stop <= len(words)).tolist():
        out.setdefault(i, set()).add(int(stop[i]) - i)
    begin = np.searchsorted(sums, sums[1:] - least, "right") - 1
    for i in line[sums[1:] >= least].tolist():
        out.setdefault(int(begin[i]), set()).add(i + 1 - int(begin[i]))
    return out


def named(docs: DataFrame) -> DataFrame:
    """docs (id, text) with name, the text's digest, and no null texts."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("name", F.xxhash64("text"))


def _shared(texts: DataFrame) -> DataFrame:
    """(name, first, n) of the texts that several rows of texts (id, name) have; first: (whether the id is null, the id)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    return texts.groupBy("name").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")


def _lines(texts: DataFrame, least: int) -> DataFrame:
    """(name, id, line, key, sizes): the lines of texts (id, name, text), with the lengths of the runs to look at from each.

    A text that several rows of a task have is given once."""

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            rows, lines, keys, sizes = [], [], [], []
            for row, (name, text) in enumerate(zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if name in done:
                    continue
                done.add(name)
                parts = text.split("\n")
                found = windows(np.array([len(p.split()) for p in parts]), least)
                if not found:
                    continue
                for i, part in enumerate(parts):
                    rows.append(row)
                    lines.append(i)
                    keys.append(xxhash.xxh3_128_digest(part.encode()))
                    sizes.append(sorted(found.get(i, ())))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("name").take(at), batch.column("id").take(at), pa.array(lines, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))], names=["name", "id", "line", "key", "sizes"])
        hand_back()

    return texts.select("id", "name", "text").mapInArrow(run, f"name long, id {texts.schema['id'].dataType.simpleString()}, line long, key binary, sizes array<long>")


def ordered(suffixes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(name, line, rank) of the suffixes whose keys others share; rank: the place of the first of them in the order of keys.

    total: at least the number of suffixes."""
    spark = suffixes.sparkSession
    groups = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def run(batches):
        at = 0
        for b in batches:
            n = np.asarray(b.column("n"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + np.cumsum(n) - n, pa.int64())], names=[*b.schema.names, "at"])
            at += int(n.sum())

    groups = written(groups.mapInArrow(run, T.StructType([*groups.schema.fields, T.StructField("at", T.LongType())])), "order")
    sizes = sorted(tuple(r) for r in groups.groupBy("part").agg(F.sum("n")).collect())  # as many as partitions
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    bases = spark.createDataFrame([(part, base) for (part, _), base in zip(sizes, before)], "part int, base long")
    own = [F.col(c).alias(f"key_{c}") for c in keys]
    ranks = groups.join(F.broadcast(bases), "part").select(*own, "n", (F.col("base") + F.col("at")).alias("rank"))
    out = hot_join(suffixes.select("name", "line", *own), ranks, [f"key_{c}" for c in keys], "n", total)
    return out.select("name", "line", "rank")


def doubled(ranks: DataFrame, width: int) -> DataFrame:
    """(name, line, rank, rank2) of the suffixes of ranks for `width` lines that may tie for twice as many."""
    half = ranks.select("name", (F.col("line") - width).alias("line"), F.col("rank").alias("rank2"))
    return ranks.join(half, ["name", "line"])


def repeated_runs(texts: DataFrame, shared: DataFrame, least_words: int = 20) -> DataFrame:
    """(name, first, size): runs of lines of texts (id, name, text) that are later copies; they may overlap.

    shared: as from _shared(). Whole texts that other rows have too aren't told."""
    met = _lines(texts, least_words).join(shared.drop("n"), "name", "left")
    once = met.filter("first is null").withColumn("first", F.struct(F.col("id").isNull().alias("none"), "id"))
    lines = written(once.unionByName(met.filter("first is not null").dropDuplicates(["name", "line"])).drop("id"), "lines")
    total = lines.count()
    ranks = written(ordered(lines.select("name", "line", "key"), ["key"], total), "ranks")
    asked = lines.select("name", "line", "first", F.explode("sizes").alias("size"))
    most = asked.agg(F.max("size")).first()[0] or 0
    found, width = None, 1
    while True:
        here = asked.filter((F.col("size") >= width) & (F.col("size") < 2 * width))
        runs = here.join(ranks, ["name", "line"])
        if width > 1:
            last = ranks.select("name", F.col("line").alias("at"), F.col("rank").alias("rank2"))
            runs = runs.withColumn("at", F.col("line") + F.col("size") - width).join(last, ["name", "at"]).drop("at")
        else:
            runs = runs.withColumn("rank2", F.col("rank"))
        runs = written(runs.select("size", "rank", "rank2", F.struct("first", "name", "line").alias("place")), "runs")
        interval = runs.groupBy("size", "rank", "rank2").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = hot_join(runs, interval, ["size", "rank", "rank2"], "n", total).filter("place > earliest")
        later = written(later.select("place.name", F.col("place.line").alias("first"), "size"), "later")
        found = later if found is None else found.unionAll(later)
        if most < 2 * width:
            return found
        ranks = written(ordered(doubled(ranks, width), ["rank", "rank2"], total), "ranks")
        if ranks.isEmpty():
            return found
        width *= 2


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 20) -> DataFrame:
    """docs with kept_text, n_lines and removed_runs (maximal runs of deleted lines as (first, size)); these names are replaced."""
    own = docs.withColumn("__name", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = named(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    shared = written(_shared(texts.select("id", "name")), "shared")
    spans = repeated_runs(texts, shared, least_words).groupBy("name").agg(F.collect_set(F.struct("first", "size")).alias("__spans"))
    table = spans.join(shared, "name", "full").select(F.col("name").alias("__name"), "__spans", F.col("first").alias("__first"), F.coalesce("n", F.lit(1).cast("long")).alias("__n"))
    table = written(table, "spans")
    kind = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("size", T.LongType())]))

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        kept, counts, runs = [], [], []
        for value, spans, copy in zip(*(batch.column(c).to_pylist() for c in (text, "__spans", "__copy")), strict=True):
            parts = (value or "").split("\n")
            counts.append(len(parts))
            if copy:  # of a text that an earlier row has
                spans = [{"first": 0, "size": len(parts)}] if len((value or "").split()) >= least_words else []
            if not spans:
                kept.append(value)
                runs.append([])
                continue
            gone: list[list[int]] = []
            for a, b in sorted((s["first"], min(s["first"] + s["size"], len(parts))) for s in spans):
                if gone and a <= gone[-1][1]:
                    gone[-1][1] = max(b, gone[-1][1])
                else:
                    gone.append([a, b])
            edges = [0, *(x for g in gone for x in g), len(parts)]
            kept.append("\n".join(p for a, b in zip(edges[::2], edges[1::2], strict=True) for p in parts[a:b]))
            runs.append([{"first": a, "size": b - a} for a, b in gone])
        return [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())])))]

    joined = hot_join(own, table, ["__name"], "__n", docs.count(), "left", alike=True)
    joined = joined.withColumn("__copy", F.coalesce((F.col("__n") > 1) & ~F.col(f"`{key}`").eqNullSafe(F.col("__first.id")), F.lit(False)))
    out = mapped(joined.drop("__first", "__n"), step, [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("removed_runs", kind)])
    return out.drop("__spans", "__copy", "__name")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: per document n_lines, n_removed, n_runs and the digest of the text that is left."""
    out = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("removed_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
