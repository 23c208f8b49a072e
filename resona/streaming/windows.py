"""Event-time windows that run alike on batches and streams, and the streaming job around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """event_type, start, n, rms of fixed windows over ts."""
    w = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return w.select("event_type", F.col("w.start").alias("start"), "n", "rms")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n, total of sessions that end after a pause of `gap`."""
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", "total")


def event_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Parquet files of events as a stream with event time and a watermark."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_tumbling(spark: SparkSession, folder: str, out: str, checkpoint: str, width: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Closed windows, appended as Parquet once each; takes all files there are and ends."""
    stream = tumbling(event_stream(spark, folder, late), width)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
