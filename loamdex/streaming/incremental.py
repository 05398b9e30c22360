"""Structured Streaming: document sync by micro-batch, and (extensions) windows, sessions and deduplication of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def document_sync(spark: SparkSession, source: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, per_trigger: int = 100) -> StreamingQuery:
    """Feed new Parquet files of a folder to ``apply`` (a versioned upsert) batch by batch, each once, until all are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: start, event_type, n, total in windows of event time; works on batches and streams."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Extension: user_id, start, end, n of activity without a pause of ``gap``."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Extension: each event the first time its id is seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
