"""Adaptive Golomb coding of an event stream: the state of a coder lives in the stream's keyed state.

Every event type is a context of its own. Micro-batches arrive in any size; within one, a context's symbols are
taken in the order of their ids, so bits depend on the arrival order of batches only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import Rate

OUT = "event_type string, n long, bits long"
STATE = "total long, count long, n long, bits long"


def _coded(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    total, count, n, bits = state.get if state.exists else (4, 1, 0, 0)
    rate = Rate(int(total), int(count))
    rows = pd.concat(list(batches)).sort_values("event_id")
    for m in rows["m"].tolist():
        bits += rate.price(m, m)
        n += 1
    state.update((rate.total, rate.count, int(n), int(bits)))
    yield pd.DataFrame({"event_type": [key[0]], "n": [int(n)], "bits": [int(bits)]})


def adaptive_bits(events: DataFrame) -> DataFrame:
    """Running totals by event type of a stream (or, in one batch, a table) of events (event_id, event_type, value)."""
    symbols = events.select("event_id", "event_type", F.floor("value").cast("long").alias("m"))
    return symbols.groupBy("event_type").applyInPandasWithState(_coded, OUT, STATE, "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their mean value by type and tumbling window, final once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
