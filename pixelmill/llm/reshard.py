"""Resharding by minimum-cost flow.

Old shards with their sizes are sources, new shards with their capacities sinks; a byte costs nothing where
it stays and one where it moves. The cheapest flow says how many bytes go from each old shard to each new
one. What moves is an item: a group of rows with equal texts, or else a row. A group starts from the old shard that holds
most of its bytes. Each old shard is cut into blocks (by size class, largest first, then by a hash); whole blocks follow the
flow, and a block at a cut is split between items by their running size. As the parts that move are cut from the end,
where items are small, new sizes miss their capacities by little. Only the files of shards that lose or gain rows need to
be written again (rewrite()).

A group of more than a quarter of a new shard would upset the sizes, which are to be near equal: its rows are items of their own.

The driver sees block sizes (at most old shards * 64 classes * `blocks`), row counts (new shards * 16 * `blocks`) and the
flow, never rows. Null keys, repeated rows and ties are ordered by hash, key and checksum; equal rows may swap places. A
null text has the size 8 and equals an empty one. Texts are whole, whatever their length, and known by their MD5. Empty
tables give empty results. Only the key, of any type, and the text are read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import hot_join, read, written


def cheapest(supply: list[int], capacity: list[int], stays: dict[int, int]) -> dict[tuple[int, int], int]:
    """The flow {(old, new): bytes} that moves the fewest bytes. stays: the new shard that an old one becomes.

    Successive shortest paths with potentials on the graph source -> old -> new -> sink."""
    n, m = len(supply), len(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(size)]
    to, left, cost = [], [], []

    def arc(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    pairs = {}
    for i in range(n):
        for j in range(m):
            pairs[i, j] = len(to)
            arc(i, n + j, supply[i], 0 if stays.get(i) == j else 1)
    high = [0] * size
    while True:
        far, back, queue = [None] * size, [-1] * size, [(0, source)]
        far[source] = 0
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                if left[e] and (far[to[e]] is None or d + cost[e] + high[x] - high[to[e]] < far[to[e]]):
                    far[to[e]], back[to[e]] = d + cost[e] + high[x] - high[to[e]], e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if far[sink] is None:
            break
        high = [h + (f or 0) for h, f in zip(high, far, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(back[x])
            x = to[back[x] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push
    return {p: left[e ^ 1] for p, e in pairs.items() if left[e ^ 1]}


def resharded(docs: DataFrame, old_shards: int = 16, new_shards: int = 24, key: str = "doc_id", text: str = "text", blocks: int = 32) -> DataFrame:
    """key, size, text_crc32, old_shard, shard and slot of every row; sizes of the new shards are near equal."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    h = F.xxhash64(name, F.when(F.col(key).isNull(), raw))  # so that null keys are dealt by their texts
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("crc"), (F.crc32(name.cast("binary")) % old_shards).cast("int").alias("old"), h.alias("h"), F.unhex(F.md5(raw)).alias("g"))
    rows = written(rows, "texts")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # groups of equal texts: where most of their bytes lie (of ties the first shard), unless they would upset the sizes
    parts = rows.groupBy("g", "old").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"))
    groups = parts.groupBy("g").agg(F.sum("b").alias("weight"), F.sum("c").alias("n"), F.max_by("old", F.struct("b", -F.col("old"))).alias("home"))
    groups = written(groups.filter((F.col("n") > 1) & (F.col("weight") <= total // new_shards // 4)), "groups")
    rows = written(hot_join(rows, groups.select("g", "n"), ["g"], "n", n_rows, "left"), "rows")
    alone, grouped = rows.filter("n is null"), rows.filter("n is not null").drop("n")
    fields = ["id", "size", "crc", "old", "h"]
    items = alone.select(*fields, F.col("old").alias("home"), F.col("size").alias("weight"), F.lit(None).cast("binary").alias("g"), F.lit(None).cast("long").alias("n"))
    none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in ("id", "size", "crc", "old")]
    items = items.unionByName(groups.select(*none, F.xxhash64("g").alias("h"), "home", "weight", "g", "n"))
    # a block: size class (64 - log2, so that large items come first) and hash
    items = items.withColumn("block", ((F.lit(63) - F.floor(F.log2("weight"))) * blocks + F.pmod("h", F.lit(blocks))).cast("int"))
    sizes = sorted(tuple(r) for r in items.groupBy("home", "block").agg(F.sum("weight")).collect())
    supply = [sum(s for o, _, s in sizes if o == i) for i in range(old_shards)]
    capacity = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    flow = cheapest(supply, capacity, {i: i for i in range(min(old_shards, new_shards))})
    # in each old shard, what stays comes first; then the moves, each an interval of the running size
    cuts: dict[int, tuple[list[int], list[int]]] = {}
    for i in range(old_shards):
        bounds, dests, at = [], [], 0
        for j in sorted((j for o, j in flow if o == i), key=lambda j: (j != i, j)):
            bounds.append(at)
            dests.append(j)
            at += flow[i, j]
        cuts[i] = (bounds or [0], dests or [min(i, new_shards - 1)])
    table, at = [], dict.fromkeys(range(old_shards), 0)
    for o, b, s in sizes:
        bounds, dests = cuts[o]
        lo, hi = bisect_right(bounds, at[o]) - 1, bisect_right(bounds, at[o] + s) - 1
        table.append((o, b, at[o], bounds[lo : hi + 1], dests[lo : hi + 1]))
        at[o] += s
    plan = spark.createDataFrame(table, "home int, block int, base long, bounds array<long>, dests array<int>")
    w = Window.partitionBy("home", "block").orderBy("h", "g", "id", "crc", "weight").rowsBetween(Window.unboundedPreceding, 0)
    run = items.withColumn("before", F.sum("weight").over(w) - F.col("weight"))
    # at most old_shards * 64 * blocks rows, a bound set by parameters
    run = run.join(F.broadcast(plan), ["home", "block"])
    middle = F.col("base") + F.col("before") + F.floor(F.col("weight") / 2)
    put = run.withColumn("shard", F.get("dests", F.greatest(F.lit(0), F.size(F.filter("bounds", lambda b: b <= middle)) - 1)))
    put = written(put.select(*fields, "g", "n", "shard"), "items")
    together = hot_join(grouped, put.filter("n is not null").select("g", "n", "shard"), ["g"], "n", n_rows)
    placed = put.filter("n is null").select(*fields, "shard").unionByName(together.select(*fields, "shard"))
    # slots: rows of a shard are dealt to buckets by the hash of their keys, so that a large group fills no task alone
    placed = written(placed.withColumn("bucket", F.pmod("h", F.lit(16 * blocks)).cast("int")), "placed")
    offsets, seen = [], {}
    for s, k, n in sorted(tuple(r) for r in placed.groupBy("shard", "bucket").agg(F.count(F.lit(1))).collect()):
        offsets.append((s, k, seen.get(s, 0) - 1))
        seen[s] = seen.get(s, 0) + n
    where = spark.createDataFrame(offsets, "shard int, bucket int, offset long")
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "id", "crc", "size"))
    # at most new_shards * 16 * blocks rows
    out = placed.withColumn("nth", nth).join(F.broadcast(where), ["shard", "bucket"])
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", (F.col("offset") + F.col("nth")).alias("slot"))


def rewrite(docs: DataFrame, plan: DataFrame, path: str, key: str = "doc_id") -> list[int]:
    """Write the rows of every shard that loses or gains rows to path/shard=N; the shards left alone are returned.

    Keys must be unique. docs and plan are joined by key, so the rows are dealt evenly."""
    moved = plan.filter(F.col("old_shard") != F.col("shard")).select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    touched = sorted(r[0] for r in moved.collect())  # shard numbers, bounded by their count
    mine = plan.filter(F.col("shard").isin(touched)).select(F.col(key).alias("__key"), "shard", "slot") if touched else None
    if mine is not None:
        rows = docs.join(mine, docs[key] == mine["__key"]).drop("__key")
        rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return sorted({r[0] for r in plan.select("shard").distinct().collect()} - set(touched))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: see the contract; one row per document."""
    out = resharded(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard")
