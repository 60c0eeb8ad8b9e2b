"""Graph records as streams: windowed counts with late rows, and files of records that extend a graph batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Rows (window_start, window_end, keys, n); a stream forgets windows that ended before its watermark."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = timed.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Rows (key, session_start, session_end, n): events of one key that are less than gap apart."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = timed.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def append_edges(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream of (_id, _src, _dst, …) to Parquet once each, where a graph's relationship table can read it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
