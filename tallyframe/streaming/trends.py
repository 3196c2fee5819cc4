"""Weekly sums and dedup of event streams; an extension beside the batch operators.

Watermarks bound the state: a week is done once the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly(events: DataFrame, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """(week, value, rows) of Monday-based weeks, on a stream or a batch."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    return (
        timed.groupBy(F.window("_ts", "7 days", "7 days", "4 days").alias("w"))
        .agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"), F.count("*").alias("rows"))
        .select(F.to_date("w.start").alias("week"), "value", "rows")
    )


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first of each key within the watermark's reach."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])
