"""Structured Streaming over the batch operators: deduplicated, keyed, replay-safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(stream: DataFrame, key: str, ts: str, delay: str = "14 days") -> DataFrame:
    """Each key once; a key's state is dropped when the watermark has passed it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_mentions(stream: DataFrame, size: str, slide: str | None, delay: str) -> DataFrame:
    """Mentions and mean sentiment per ticker in tumbling or sliding windows."""
    w = F.window("created_utc", size, slide) if slide else F.window("created_utc", size)
    return stream.withWatermark("created_utc", delay).groupBy(w, "ticker").agg(F.count(F.lit(1)).alias("mentions"), F.avg("sentiment_score").alias("avg_sentiment"))
