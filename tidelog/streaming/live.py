"""The same event schema as a stream: hourly counts and sessions with late events bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events of each location and hour; append mode closes an hour once it is late enough."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy("geo_location", F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("geo_location", F.col("w.start").alias("hour"), "n")


def sliding_counts(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy("geo_location", F.window("at", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("geo_location", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_sessions(events: DataFrame, gap: str = "1800 seconds", late: str = "2 hours") -> DataFrame:
    """Sessions of each location; a pause of more than the gap ends one, as in batch."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy("geo_location", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("geo_location", F.col("w.start").alias("start"), "n")
