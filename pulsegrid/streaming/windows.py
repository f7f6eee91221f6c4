"""Rates over a stream of events: event-time windows with a watermark. Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rate(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per track and window; rows later than ``late`` behind the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy("track_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n_events"), F.avg("value").alias("mean_value"))
