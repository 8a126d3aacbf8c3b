"""Streams: windows over events with watermarks, and adoption of result rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import append_rows


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which takes instants; times without zone are in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` by windows of event time; works on tables and on streams."""
    e = _watermarked(events, late)
    w = e.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n``: events of a user that follow one another within ``gap``."""
    e = _watermarked(events, late)
    w = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def adopt(records: DataFrame, path: str, checkpoint: str, key: str = "null_id") -> StreamingQuery:
    """Append the rows of a stream to a Parquet table, each key once, whatever is delivered again."""
    return records.writeStream.foreachBatch(lambda batch, _: append_rows(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
