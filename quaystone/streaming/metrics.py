"""Event-time metrics over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.requests import status_class


def windowed_counts(requests: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests and bytes by window, method and status class. Rows later than ``late`` are dropped with the state."""
    span = F.window("time", window, slide) if slide else F.window("time", window)
    out = requests.withWatermark("time", late).groupBy(span.alias("w"), "method", status_class(F.col("status")).alias("class")).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("w.start").alias("start"), "method", "class", "requests", "bytes")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "access_key") -> DataFrame:
    out = requests.withWatermark("time", late).groupBy(by, F.session_window("time", gap).alias("w")).agg(F.count("*").alias("requests"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def deduplicated(events: DataFrame, *keys: str, time: str = "time", late: str = "10 minutes") -> DataFrame:
    """Each event once while its key is within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
