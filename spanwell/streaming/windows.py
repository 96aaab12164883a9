"""Event-time windows of the engine itself: tumbling, hopping and session windows over the events table.

The same functions take a streaming DataFrame; a watermark then bounds their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table


def _hour(start):
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), start) / F.lit(3600000000)).cast("long")


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which takes instants; wall-clock times are read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, late: str = "1 hour") -> DataFrame:
    e = _watermarked(events, late)
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", _hour(F.col("w.start").cast("timestamp_ntz")).alias("hour"), "n")


def hopping(events: DataFrame, late: str = "1 hour") -> DataFrame:
    e = _watermarked(events, late)
    g = e.groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", _hour(F.col("w.start").cast("timestamp_ntz")).alias("hour"), "n")


def sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sessions of each user, counted by size."""
    e = _watermarked(events, late)
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def _query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"))

    return run


QUERIES = {
    "tumbling_watermark": _query(tumbling),
    "hopping_windows": _query(hopping),
    "native_sessions": _query(lambda e: sessions(e).groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))),
}
