"""Event replay as a stream: click counts in event-time windows with a watermark.

An extension of the batch library: usage labels can be kept up to date while events
arrive. State is bounded by the watermark; late events beyond it are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over Parquet files of events that appear in ``folder``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total for tumbling windows; batch frames work too."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counts = marked.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def start(counts: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to Parquet, exactly once, until all present files are read."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
