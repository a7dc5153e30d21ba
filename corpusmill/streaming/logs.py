"""Streams: event-time buckets, late feedback, incremental skipping of what has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_buckets(events: DataFrame, hours: int = 1, late: str = "1 hour") -> DataFrame:
    """bucket, total, success, failed, avg_total_ms of an ingest stream (at, total_ms, ok), in append or update mode."""
    rows = events.withWatermark("at", late).groupBy(F.window("at", f"{hours} hours").alias("w"))
    out = rows.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.floor(F.avg("total_ms")).cast("long").alias("avg_total_ms"))
    return out.select(F.col("w.start").alias("bucket"), "total", "success", (F.col("total") - F.col("success")).alias("failed"), "avg_total_ms")


def with_feedback(queries: DataFrame, feedback: DataFrame, within: str = "7 days") -> DataFrame:
    """Query events (query_id, at, ...) with the feedback (query_id, given_at, useful) given within a time, or null.

    Both sides' state is bounded by their watermarks.
    """
    q = queries.withWatermark("at", within)
    f = feedback.select(F.col("query_id").alias("__id"), "given_at", "useful").withWatermark("given_at", within)
    near = (F.col("query_id") == F.col("__id")) & (F.col("given_at") >= F.col("at")) & (F.col("given_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return q.join(f, near, "left").drop("__id")


def unseen(chunks: DataFrame, key: list[str], at: str, within: str = "1 day") -> DataFrame:
    """The first row of each key in a stream; keys are forgotten after a time."""
    return chunks.withWatermark(at, within).dropDuplicatesWithinWatermark(key)
