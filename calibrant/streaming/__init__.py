"""Incremental evaluation: arriving predictions against fixed thresholds (an extension, not part of the batch contract)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_coverage(predictions: DataFrame, lac_threshold: float, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``(ts, p_correct)`` rows to coverage by event-time window; works on a stream and on a table."""
    hit = (F.col("p_correct") >= 1.0 - lac_threshold).cast("int")
    return predictions.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("covered"))
