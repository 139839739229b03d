"""Provider health in tumbling windows, the same plan for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_health(calls: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """since, provider, calls, errors, latency_ms (of calls that have one) for each tumbling window.

    On a stream a window is kept until calls come that are ``late`` later than its end, so the
    state does not grow with the stream; on a table the watermark has no effect.
    """
    # Watermarks need an instant; the table's times name no zone, and neither does the result.
    x = calls.withColumn("called_at", F.col("called_at").cast("timestamp")).withWatermark("called_at", late).groupBy(F.window("called_at", size), "provider")
    x = x.agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.avg("latency_ms").alias("latency_ms"))
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("since"), "provider", "calls", "errors", "latency_ms")
