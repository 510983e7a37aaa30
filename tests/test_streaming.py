"""Streams give what their batch replays give."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracet.streaming import jobs


def logs(spark):
    rows = [(i, f"2024-01-01 0{i % 6}:{i % 60:02d}:00", "completed" if i % 3 else "failed", i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "id int, at string, status string, extracted int").withColumn("ts", F.to_timestamp("at")).drop("at")


def test_windowed_stream_equals_batch(spark, tmp_path):
    logs(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs(spark).schema).parquet(str(tmp_path / "in"))
    q = jobs.windowed(stream, "ts", "2 hours", None, ["status"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = jobs.windowed(logs(spark), "ts", "2 hours", None, ["status"])
    assert sorted(spark.table("w").collect()) == sorted(want.collect())


def test_deduplicated_stream(spark, tmp_path):
    rows = logs(spark).withColumn("key", F.col("id") % 7)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.deduplicated(stream, ["key"], "ts", "10 days").writeStream.format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["key"] for r in spark.table("d").collect()) == list(range(7))


def test_upserting_batches(spark, tmp_path):
    rows = logs(spark)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    jobs.upserting(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c")).awaitTermination()
    assert sum(n for _, n in seen) == 60
