"""Event streams: windowed counts with a watermark, and latest-value state, over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, value: str, keys: list[str], window: str, lateness: str) -> DataFrame:
    """count, sum per key and tumbling window; rows later than the watermark are left out. Works on streams and tables."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def file_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
