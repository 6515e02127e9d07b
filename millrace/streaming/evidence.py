"""Streaming forms of the event operators; each equals its batch form under availableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.routing import route


def rates(events: DataFrame, t: str, window: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """STM-11: events a window and type; rows later than the watermark are dropped (STM-09)."""
    x = events.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late)
    return x.groupBy(F.window("_t", window, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, t: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """STM-11 as sessions by user."""
    x = events.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late)
    return x.groupBy("user_id", F.session_window("_t", gap)).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, t: str, key: str, late: str = "1 hour") -> DataFrame:
    """STM-06: one row a key within the watermark."""
    return events.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key])


def routed(evidence: DataFrame) -> DataFrame:
    """STM-01 on a stream: every row with its rule; stateless, as conditions come with the row."""
    return evidence.withColumn("decision", route(F.coalesce(F.col("stage"), F.lit("")), F.coalesce(F.col("signal"), F.lit(""))))
