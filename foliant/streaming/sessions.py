"""Sessions and deduplicated events over streams, the incremental form of operators.state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string", files: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Closed sessions; state of a session is dropped once the watermark has passed its end."""
    kept = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    found = kept.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by type in tumbling (or sliding) windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")
