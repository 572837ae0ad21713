"""Rasters as tables of rows.

A raster row is one record: (img, i, r, g, b) with an array of samples per channel. Rows keep a raster's
horizontal order without a sort and need one shuffle, by image, to see the rows above (operators.neighbors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 21 RGB images: a row per vector, three dimensions per pixel, v = clamp(floor(x * 255 + 128))."""
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 255 + 128).cast("int"))))
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), level.alias("s"))
    channel = lambda k: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.get("s", j * 3 + k))
    return df.select(F.expr("vec_id div 64").alias("img"), F.expr("cast(vec_id % 64 as int)").alias("i"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 RGB images from events in id order: value, hour and type. A short last row is filled up with its last pixel."""
    code = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type"))
    px = F.struct(F.expr("cast(event_id % 64 as int)").alias("j"), F.expr("cast(floor(value) % 256 as int)").alias("r"), (F.hour("ts") * 10).alias("g"), ((code - 1) * 50).cast("int").alias("b"))
    df = table(spark, sf_dir, "events").select(F.expr("event_id div 4096").alias("img"), F.expr("cast((event_id % 4096) div 64 as int)").alias("i"), px.alias("px"))
    rows = df.groupBy("img", "i").agg(F.array_sort(F.collect_list("px")).alias("p")).withColumn("p", _filled("p", 64))
    return rows.select("img", "i", "p.r", "p.g", "p.b")


def _filled(row: str, width: int) -> Column:
    """The array with its last element repeated up to a width."""
    return F.concat(row, F.array_repeat(F.element_at(row, -1), width - F.size(row)))


def document_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, ch, i, row): code points modulo 256 of all documents in rows of 64; a short last row is filled up with its last value."""
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("img"), "text", F.expr("(length(text) + 63) div 64").alias("rows"))
    df = df.filter("rows > 0").select("img", "text", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
    chars = F.split(F.substr("text", F.col("i") * 64 + 1, F.lit(64)), "")
    return df.select("img", F.lit(0).alias("ch"), F.col("i").cast("int").alias("i"), F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c) % 256).alias("row")).withColumn("row", _filled("row", 64))


def gradient_raster(spark: SparkSession, size: int = 64) -> DataFrame:
    """A synthetic image with r = j, g = i, b = 128."""
    j = F.sequence(F.lit(0), F.lit(size - 1))
    return spark.range(size).select(F.lit(0).cast("long").alias("img"), F.col("id").cast("int").alias("i"), j.alias("r"), F.transform(j, lambda x: F.col("id").cast("int")).alias("g"), F.transform(j, lambda x: F.lit(128)).alias("b"))


def bars_raster(spark: SparkSession, size: int = 64, width: int = 8) -> DataFrame:
    """A synthetic image of vertical bars that alternate between 0 and 255, with a horizontal band in blue."""
    j = F.sequence(F.lit(0), F.lit(size - 1))
    bar = lambda x: F.when(F.floor(x / width) % 2 == 0, 0).otherwise(255)
    return spark.range(size).select(F.lit(0).cast("long").alias("img"), F.col("id").cast("int").alias("i"), F.transform(j, bar).alias("r"), F.transform(j, lambda x: F.lit(255) - bar(x)).alias("g"), F.transform(j, lambda x: bar(F.col("id").cast("int"))).alias("b"))


def noise_at(i: str, j: str, channel: int) -> str:
    """An expression (for either engine) of a scrambled value 0..255 of a place."""
    return f"CAST(floor((({i}) * 7919 + ({j}) * 104729 + {channel} * 1299709) * CAST(2654435761 AS BIGINT) % 4294967296 / 16777216) AS INTEGER)"


def blurred_at(i: str, j: str, channel: int, size: int = 64, rounds: int = 3) -> str:
    """noise_at() after rounds of averages of a place and its four neighbours, across the edges; rounded down at the end."""
    kernel = {(0, 0): 1}
    for _ in range(rounds):
        wider: dict[tuple[int, int], int] = {}
        for (y, x), w in kernel.items():
            for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
                wider[y + dy, x + dx] = wider.get((y + dy, x + dx), 0) + w
        kernel = wider
    terms = [f"{w} * {noise_at(f'(({i}) + {y + size}) % {size}', f'(({j}) + {x + size}) % {size}', channel)}" for (y, x), w in sorted(kernel.items())]
    return f"CAST(floor(({' + '.join(terms)}) / CAST({5**rounds} AS DOUBLE)) AS INTEGER)"


def banded_at(i: str, j: str, size: int = 64) -> str:
    """A ramp from left to right with a little noise."""
    return f"greatest(0, least(255, CAST(floor(({j}) * 255 / CAST({size - 1} AS DOUBLE)) AS INTEGER) + {noise_at(i, j, 3)} % 17 - 8))"


def synthetic(spark: SparkSession, channels: tuple[str, str, str], size: int = 64) -> DataFrame:
    """One image from an expression of i and j for each channel."""
    px = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: j)
    cells = spark.range(size).select(F.col("id").cast("int").alias("i"), F.posexplode(px).alias("j", "at"))
    cells = cells.select("i", F.struct("j", *[F.expr(x).alias(c) for c, x in zip("rgb", channels, strict=True)]).alias("p"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select(F.lit(0).cast("long").alias("img"), "i", "p.r", "p.g", "p.b")


NOISE = tuple(noise_at("i", "j", k) for k in range(3))
BLURRED = tuple(blurred_at("i", "j", k) for k in range(3))
#: The ramp, the same 40 rows and the same 16 columns on.
BANDED = (banded_at("i", "j"), banded_at("(i + 24) % 64", "j"), banded_at("i", "(j + 48) % 64"))


def pixels(rgb: DataFrame) -> DataFrame:
    """(img, i, j, r, g, b) of an RGB row table."""
    zipped = F.arrays_zip("r", "g", "b")
    return rgb.select("img", "i", F.posexplode(zipped).alias("j", "p")).select("img", "i", "j", "p.r", "p.g", "p.b")


def planes(rgb: DataFrame, convert=None) -> DataFrame:
    """(img, ch, i, row) of an RGB row table; convert(r, g, b) gives the three channels of a pixel."""
    zipped = F.arrays_zip("r", "g", "b")

    def channel(k: int) -> Column:
        return F.transform(zipped, lambda p: (convert(p["r"], p["g"], p["b"]) if convert else (p["r"], p["g"], p["b"]))[k])

    chans = F.array(*[F.struct(F.lit(k).alias("ch"), channel(k).alias("row")) for k in range(3)])
    return rgb.select("img", "i", F.explode(chans).alias("c")).select("img", "c.ch", "i", "c.row")
