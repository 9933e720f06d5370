"""Event aggregates that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame) -> DataFrame:
    """(day, event_type, n, value): counts and sums of each day."""
    rows = events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.withColumn("day", F.col("day").cast("timestamp_ntz"))


def timed(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The stream with its event time as `at`, under a watermark."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def windowed(timed_stream: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, value) of a timed stream: tumbling windows; events behind the watermark are left out.

    State holds one row per open window and type; a window is given out once the watermark passes its end.
    """
    rows = timed_stream.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def deduplicated(timed_stream: DataFrame, key: str = "event_id") -> DataFrame:
    """The timed stream without repeats of a key that come within the watermark's delay of each other."""
    return timed_stream.dropDuplicatesWithinWatermark([key])
