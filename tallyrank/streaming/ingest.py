"""Event streams to windowed interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """user, item, label, window start: rows and summed values in tumbling windows; late rows are dropped after `late`."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", width).alias("w"), F.col("user_id").alias("user"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"), F.sum("value").alias("label"))
    return out.select("user", "item", F.col("w.start").alias("start"), "n", "label")
