from __future__ import annotations

from pyspark.sql import functions as F

from resona.streaming.windows import run_tumbling, tumbling


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(source)
    q = run_tumbling(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"), "1 day", "1 hour")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    closed = want.join(got.select("event_type", "start", F.col("n").alias("m")), ["event_type", "start"])
    assert got.count() > 0
    assert closed.where("n <> m").count() == 0
