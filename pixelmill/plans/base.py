"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import ycocg
from ..operators import neighbors, predictors
from ..sources import rasters

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def put(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.oracles[key] = sql
            return f

        return put


SOURCES = {"emb": rasters.embedding_raster, "evt": rasters.event_raster}


def planes(spark: SparkSession, sf_dir: str, source: str = "emb") -> DataFrame:
    """YCoCg planes of a raster."""
    return rasters.planes(SOURCES[source](spark, sf_dir), ycocg)


def taps(spark: SparkSession, sf_dir: str, source: str = "emb") -> DataFrame:
    """YCoCg samples with copied-border neighbours."""
    return neighbors.edge_copied(neighbors.raw_taps(planes(spark, sf_dir, source)))


def med_residuals(spark: SparkSession, sf_dir: str, source: str = "emb") -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return taps(spark, sf_dir, source).withColumn("r", F.col("v") - predictors.med(a, b, c))


def expert_residuals(spark: SparkSession, sf_dir: str, source: str = "emb", keep=()) -> DataFrame:
    """img, ch, i, j, v, keep, ord, expert, p and r = v - p for the sixteen experts."""
    df = taps(spark, sf_dir, source)
    return predictors.unpivoted(df, predictors.bank(), ["img", "ch", "i", "j", "v", *keep]).withColumn("r", F.col("v") - F.col("p"))


def residual_rows(spark: SparkSession, sf_dir: str, source: str = "emb") -> DataFrame:
    """Median-edge residuals as planes (img, ch, i, row)."""
    return predictors.med_rows(planes(spark, sf_dir, source))


def residual_samples(spark: SparkSession, sf_dir: str, source: str = "emb") -> DataFrame:
    """(img, ch, r): the median-edge residual of every YCoCg sample, in no order."""
    return predictors.med_samples(SOURCES[source](spark, sf_dir), ycocg)
