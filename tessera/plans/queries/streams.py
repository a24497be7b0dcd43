"""Window query over the events table (the same plan that streams use)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import fixtures as fx
from tessera.registry import register
from tessera.streaming.windows import windowed


@register("events_windowed", "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, user_id, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM events GROUP BY ALL")
def _windowed(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("value").cast("double").alias("value"))
    w = windowed(e, "ts", "value", ["user_id"], "1 hour", "10 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n", F.round("total", 4).alias("total"))
