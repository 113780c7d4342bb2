"""The batch text functions over a stream of message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.instants import instant
from skein.functions.text import clean, private_channel


def cleaned(rows: DataFrame) -> DataFrame:
    """Messages with their masked text, as they come; stateless, so it is the same on batches."""
    return rows.select("tweet_id", "author_id", clean(F.col("text")).alias("clean"), private_channel(F.col("text")).alias("private_channel"), F.timestamp_seconds(instant(F.col("created_at"))).alias("event_time"))


def volume(rows: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Messages an author and window, emitted once the watermark has passed the window."""
    return cleaned(rows).withWatermark("event_time", delay).groupBy(F.window("event_time", window), "author_id").agg(F.count("*").alias("n"))
