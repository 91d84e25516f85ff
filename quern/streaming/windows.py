"""Windowed aggregates over an event stream (an extension; the batch form runs the same plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, *aggregates: Column, time: str = "ts", keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """window_start and the aggregates by window and keys. ``late`` is the watermark of a stream."""
    events = events.withColumn("__ts", F.col(time).cast("timestamp"))
    events = events.withWatermark("__ts", late) if late else events
    grouped = events.groupBy(F.window("__ts", width).alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), *[c for c in grouped.columns if c != "w"])


def sessions(events: DataFrame, gap: str, *aggregates: Column, time: str = "ts", keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    events = events.withColumn("__ts", F.col(time).cast("timestamp"))
    events = events.withWatermark("__ts", late) if late else events
    grouped = events.groupBy(F.session_window("__ts", gap).alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in grouped.columns if c != "w"])
