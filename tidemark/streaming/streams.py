"""Structured Streaming forms. Each equals its batch operator on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import article_key


def stream_bars(ticks: DataFrame, width: str, delay: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Open, close, volume per key and window; a bar appears only once its window has closed.

    ticks: the keys, ts, price, volume. Partial aggregation keeps a busy key to one row per
    window and task before the shuffle.
    """
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", F.struct("ts", "tick_id")).alias("open"), F.max_by("price", F.struct("ts", "tick_id")).alias("close"),
            F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"),
        )
        .select(*keys, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "close", "volume", "ticks")
    )


def sliding_activity(events: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Events and summed value per type on sliding windows."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("event_type", F.window("ts", width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")
    )


def session_activity(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Activity sessions per user, split by a quiet gap."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def stream_dedupe_news(articles: DataFrame, delay: str = "90 days") -> DataFrame:
    """First-seen article per link within the horizon."""
    key = F.coalesce(article_key(F.col("url")), F.col("id").cast("string"))
    return articles.withColumn("key", key).withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["key"])
