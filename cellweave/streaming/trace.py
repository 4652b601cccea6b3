"""A trace of JSON lines as a stream: windowed counts with a watermark. An extra; the batch operators need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per kind and window; the time must carry a zone, so it is cast before the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
