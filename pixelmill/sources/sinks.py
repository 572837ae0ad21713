"""Writers and readers of results: coded streams, reports and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_streams(coded: DataFrame, path: str) -> None:
    """Coded planes (with binary columns) as Parquet, one folder an image."""
    coded.write.mode("overwrite").partitionBy("img").parquet(path)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; array columns become text."""
    flat = [F.col(c).cast("string").alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_model(weights: DataFrame, thresholds: DataFrame, path: str) -> None:
    """A fitted model beside the thresholds it was fitted with."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")


def read_model(spark: SparkSession, thresholds: DataFrame, path: str) -> DataFrame | None:
    """The model, if its thresholds are exactly those given; else None."""
    held = spark.read.parquet(f"{path}/thresholds")
    same = held.columns == thresholds.columns and held.exceptAll(thresholds).isEmpty() and thresholds.exceptAll(held).isEmpty()
    return spark.read.parquet(f"{path}/weights") if same else None
