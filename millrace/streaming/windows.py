"""Windowed counts with a watermark, the same expression over a stream and over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total): events by type and window. On a stream, windows that end before the watermark are closed and
    later rows for them dropped; on a table nothing is."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """The parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def kept_tasks(tasks: DataFrame, created: str = "created_at", seconds: int = 3600) -> DataFrame:
    """A registry of tasks without those older than a time to live."""
    return tasks.filter(F.col(created) >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds)))
