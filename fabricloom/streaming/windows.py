"""Event-time windows and a run log that is read as it grows. The same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event times as instants; rows later than `late` are let go in a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of values by window and kind."""
    t = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    t = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("user_id", F.col("session_window.start").alias("start"), "n")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The option log of a sweep as a stream: name, error, seconds."""
    return spark.readStream.schema("name string, error string, seconds double").json(folder)


def follow(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps counts of done and failed options and the time they took in a table in memory of the given name."""
    t = log.agg(F.count(F.lit(1)).alias("done"), F.count("error").alias("failed"), F.sum("seconds").alias("seconds"))
    return t.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
