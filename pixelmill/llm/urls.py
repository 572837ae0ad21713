"""URL rules decided by Bloom filter cascades, in DataFrame functions only.

A rule is (host, path, block or allow). It fits its host and every subdomain, if the url's path starts with
the rule's path; of the rules that fit, the longest decides (of equally long ones of different hosts the one
with the longer host). A url's keys are its host suffixes, each with the beginnings of its path that are as
long as some rule's path: a rule fits exactly if it is one of the keys.

Membership of a key is decided without a join by a cascade over the corpus's whole key universe. Level 1 is a
Bloom filter of the listed keys, sized so that about as many other keys pass as there are listed ones; level 2
holds those false positives, level 3 the listed keys that pass level 2, and so on until nothing passes
wrongly. A key that first fails an even level (or passes an odd last one) is listed. The universe is read twice, to
count it and to find the keys that pass the first levels (of all lists at once); these few, which are written, make
the other levels. Only bit arrays, whose size follows the rule list and the logarithm of the universe, reach the
driver (about 2 MB a million rules); they return as one array literal a level. Rules may be millions.

The verdict without a rule is the method's: a url that no list names is allowed. Of a rule that is both blocked and
allowed the block counts. Nulls and urls without `://` have empty host and path, and so no rule. Urls of any length are
read whole. Repeated rows are judged row by row; null ids and other columns pass through, columns of the names added
here are replaced. An empty table or an empty rule list gives no rule.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read, written

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def keys_of(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """The keys of a url, as structs (size, host size, key): array_max picks the longest."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), n)), lambda k: F.array_join(F.slice(parts, n - (k - 1), k), "."))
    sizes = F.filter(F.from_json(F.lit(json.dumps(list(lengths))), "array<int>"), lambda size: size <= F.length(path))
    heads = F.transform(sizes, lambda size: F.substr(path, F.lit(1), size))
    return F.flatten(F.transform(ends, lambda end: F.transform(heads, lambda head: F.struct((F.length(end) + F.length(head)).alias("size"), F.length(end).alias("host"), F.concat(end, head).alias("key")))))


class Level:
    """A Bloom filter with 2^bits bits: its words that aren't 0, by number."""

    def __init__(self, bits: int, hashes: int, seed: int, words: dict[int, int]):
        self.bits, self.hashes, self.seed = bits, hashes, seed
        table = [0] * max(1, (1 << bits) // 64)
        for i, w in words.items():
            table[i] = w
        # one string that the optimizer turns into one array literal
        self.table = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    @classmethod
    def of(cls, keys: DataFrame, bits: int, hashes: int, seed: int) -> Level:
        """The filter of keys (key). The driver gets its words, as many as the bits allow."""
        place = keys.select(F.explode(F.array(*cls.places(F.col("key"), bits, hashes, seed))).alias("p"))
        words = place.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("w"))
        return cls(bits, hashes, seed, {r.word: r.w for r in words.collect()})

    @staticmethod
    def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
        low = F.lit((1 << 48) - 1)  # so that sums don't overflow
        h = F.xxhash64(key, F.lit(seed)).bitwiseAND(low)
        g = F.xxhash64(key, F.lit(seed + 1)).bitwiseAND(low).bitwiseOR(F.lit(1))
        return [(h + g * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(hashes)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for p in self.places(key, self.bits, self.hashes, self.seed):
            word = F.get(self.table, F.shiftright(p, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether the cascade holds key as listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(levels[i - 1].passes(key), out).otherwise(F.lit(i % 2 == 0))
    return out


def first_level(listed: DataFrame, number: int, size: int) -> Level:
    """The filter of `number` listed keys (key) that about as many of `size` other keys pass."""
    rate = min(0.5, max(1e-9, number / max(1, size)))
    return Level.of(listed, *_shape(number, rate), 11)


def _shape(number: int, rate: float) -> tuple[int, int]:
    return max(6, math.ceil(math.log2(max(1.0, number * 1.45 * -math.log2(rate))))), max(1, round(-math.log2(rate)))


def cascade(first: Level, listed: DataFrame, others: DataFrame, most_levels: int = 64) -> list[Level]:
    """The levels from the first on; listed and others (key): the keys of the universe that pass it, listed and not."""
    levels, inside, outside = [first], listed, others
    while len(levels) < most_levels:
        number = outside.agg(F.approx_count_distinct("key", 0.01)).first()[0]
        if not number:
            return levels
        levels.append(Level.of(outside, *_shape(number, 0.25), 2 * len(levels) + 11))
        inside, outside = outside, inside.filter(levels[-1].passes(F.col("key")))
    raise ValueError("the cascade did not end; the universe holds keys that hash alike")


def cascades(universe: DataFrame, lists: dict[str, list[str]]) -> dict[str, list[Level]]:
    """Levels that are exact on universe (a column `key`, repeats allowed) for each list of keys."""
    spark = universe.sparkSession
    own = written(spark.createDataFrame([(v, k) for v, keys in lists.items() for k in keys], "list string, key string"), "rules")
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    first = {v: first_level(own.filter(F.col("list") == v), len(keys), size) for v, keys in lists.items() if keys}
    if not first:
        return {v: [Level(6, 1, 11, {})] for v in lists}
    through = universe.select("key", F.array_compact(F.array(*[F.when(level.passes(F.col("key")), F.lit(v)) for v, level in first.items()])).alias("lists"))
    passed = through.filter(F.size("lists") > 0).select(F.explode("lists").alias("list"), "key").distinct()
    passed = written(passed.join(own.withColumn("listed", F.lit(True)), ["list", "key"], "left"), "passed")
    out = {}
    for v in lists:
        mine = passed.filter(F.col("list") == v)
        out[v] = cascade(first[v], mine.filter("listed"), mine.filter("listed is null")) if v in first else [Level(6, 1, 11, {})]
    return out


def judged(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced."""
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"} or c == url]
    host, path = F.coalesce(host_of(F.col(url)), F.lit("")), F.coalesce(path_of(F.col(url)), F.lit(""))
    labels = max([1, *(h.count(".") + 1 for h, _, _ in rules)])
    lengths = sorted({len(p) for _, p, _ in rules}) or [1]
    urls = pages.select(host.alias("host"), path.alias("path"))
    universe = urls.select(F.explode(keys_of(F.col("host"), F.col("path"), labels, lengths)).alias("k")).select(F.col("k.key").alias("key"))
    lists = {verdict: sorted({h + p for h, p, v in rules if v == verdict}) for verdict in ("block", "allow")}
    made = cascades(universe, lists)
    out = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("__host"), path.alias("__path"))
    out = out.withColumn("__keys", keys_of(F.col("__host"), F.col("__path"), labels, lengths))
    longest = lambda levels: F.array_max(F.filter("__keys", lambda k: member(levels, k["key"])))
    out = out.withColumns({f"__{verdict}": longest(levels) for verdict, levels in made.items()})
    block, allow = F.col("__block"), F.col("__allow")
    first = F.when(block.isNull() | (allow > block), F.struct(allow["key"].alias("rule"), F.lit("allow").alias("verdict"))).otherwise(F.struct(block["key"].alias("rule"), F.lit("block").alias("verdict")))
    out = out.withColumn("__first", F.when(block.isNotNull() | allow.isNotNull(), first))
    names = [F.col(f"`{c}`") for c in own if c.lower() not in {"host", "path", "rule", "verdict"}]
    return out.select(*names, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__first.rule").alias("rule"), F.coalesce("__first.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: see the contract; one row per page."""
    return judged(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
"""
