"""Rolling usage counts over a stream of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_counts(calls: DataFrame, keys: Sequence[str] = (), ts: str = "ts", length: str = "60 seconds",
                   slide: str = "10 seconds", late_by: str = "10 minutes") -> DataFrame:
    """Calls per sliding window; works alike on a stream and on a table."""
    timed = calls.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late_by)
    return (
        timed.groupBy(F.window(ts, length, slide).alias("w"), *keys)
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "requests")
    )
