"""Incremental ingestion of observations with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str = "obs_id", at: str = "loaded_at", delay: str = "7 days") -> DataFrame:
    """Each key once, however often its row is delivered within the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts of each kind in tumbling windows; late rows count within the watermark."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return rows.groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("from_ts"), "kind", "rows")
