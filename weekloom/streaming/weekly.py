"""Weekly totals of an unbounded event table; the same code serves a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_totals(events: DataFrame, late: str = "7 days", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(key, week, n, total) by tumbling weeks that start on Monday; rows later than late are dropped by a stream."""
    weeks = F.window(ts, "7 days", startTime="4 days").alias("week")  # 1970-01-05 was a Monday
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(key, weeks).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
