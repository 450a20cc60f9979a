"""Streaming sources and sinks around per-article transforms, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def article_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines articles as they arrive in a folder."""
    raw = spark.readStream.schema(schema.RAW_ARTICLE).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return schema.normalised(raw)


def annotate(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Apply a transform to each micro-batch and append the rows as parquet, once each: a batch that is
    repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and time window; works on batches and, with a watermark, on streams."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
