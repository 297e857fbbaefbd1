"""Streams of timed values: windows with late data, and the same windows over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str, late: str = "10 minutes", time: str = "ts", group: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, group, n and total of tumbling windows; on a stream, rows later than `late` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), group, "n", "total")


def time_slices(duration: float, step: float) -> list[tuple[float, float]]:
    """Consecutive (from, to) slices of a run; the last ends with it."""
    out, k = [], 0
    while k * step < duration:
        out.append((k * step, min(duration, (k + 1) * step)))
        k += 1
    return out
