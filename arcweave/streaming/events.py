"""Windows over event streams: an extension beyond batch graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Counts and sums by type and window of event time; with a stream, events later than `late` are left out."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("__t", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", user: str = "user_id") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), F.col(user).alias("user")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def stream(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)
