"""Queries over the stateful operators (T): batch replays of the streams, equal to what the streams emit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracet.plans.catalog import query
from veracet.sources import views
from veracet.streaming import jobs


@query("t03_url_dedupe", "SELECT source_name, url, min(ts) AS first_seen FROM v_logs GROUP BY ALL", "v_logs")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return jobs.first_seen(views.logs(spark, d), ["source_name", "url"], "ts")


@query(
    "t05_queue_lifecycle",
    "SELECT item_id, CASE WHEN status = 'completed' THEN 'completed' WHEN last_error IS NOT NULL AND attempts >= 2 THEN 'failed' WHEN last_error IS NOT NULL THEN 'queued' ELSE status END AS next_status FROM v_queue",
    "v_queue",
)
def t05(spark: SparkSession, d: str) -> DataFrame:
    return views.queue(spark, d).select("item_id", jobs.next_status(F.col("status"), F.col("last_error").isNotNull(), F.col("attempts"), 2).alias("next_status"))


@query(
    "t07_job_progress",
    "SELECT category, count(*) AS total, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (last_error IS NOT NULL) AS failed, CASE WHEN count(*) FILTER (status = 'completed') < count(*) THEN 'running' WHEN count(*) FILTER (last_error IS NOT NULL) = count(*) THEN 'failed' WHEN count(*) FILTER (last_error IS NOT NULL) > 0 THEN 'completed_with_failures' ELSE 'completed' END AS state FROM v_queue GROUP BY category",
    "v_queue",
)
def t07(spark: SparkSession, d: str) -> DataFrame:
    return jobs.progress(views.queue(spark, d), ["category"])


@query("t08_capacity", "SELECT source_name, log_id FROM v_logs QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY ts, log_id) <= 5", "v_logs")
def t08(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source_name").orderBy("ts", "log_id"))
    return views.logs(spark, d).withColumn("_n", n).filter("_n <= 5").select("source_name", "log_id")


@query(
    "t09_tumbling_windows",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, status, count(*) AS n, CAST(sum(extracted) AS BIGINT) AS extracted FROM v_logs GROUP BY ALL",
    "v_logs",
)
def t09(spark: SparkSession, d: str) -> DataFrame:
    return jobs.windowed(views.logs(spark, d), "ts", "6 hours", None, ["status"])


@query(
    "t09_sliding_windows",
    "SELECT start, count(*) AS n, count(*) FILTER (status = 'failed') AS failed FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS start, status FROM v_logs) GROUP BY start",
    "v_logs",
)
def t09b(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "24 hours", "6 hours")
    g = views.logs(spark, d).groupBy(w).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.select("window.start", "n", "failed")


@query(
    "t09_sessions",
    "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    g = views.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), "events")


@query(
    "t12_heartbeat_recovery",
    "SELECT item_id, CASE WHEN status <> 'processing' THEN 'keep' WHEN enqueued >= TIMESTAMP '1998-01-01' THEN 'alive' WHEN attempts < 1 THEN 'requeue' ELSE 'fail' END AS action FROM v_queue",
    "v_queue",
)
def t12(spark: SparkSession, d: str) -> DataFrame:
    action = jobs.recovery(F.col("status"), F.col("enqueued"), F.lit("1998-01-01").cast("timestamp"), F.col("attempts"), 1)
    return views.queue(spark, d).select("item_id", action.alias("action"))


@query(
    "t14_due_campaigns",
    "SELECT source_name, min(next_attempt) AS due FROM v_queue q WHERE next_attempt <= TIMESTAMP '1997-06-01' AND source_name NOT IN (SELECT source_name FROM v_queue WHERE status = 'processing') GROUP BY source_name",
    "v_queue",
)
def t14(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d)
    running = q.filter("status = 'processing'").select("source_name").distinct()
    due = q.filter(F.col("next_attempt") <= F.lit("1997-06-01").cast("timestamp")).join(running, "source_name", "left_anti")
    return due.groupBy("source_name").agg(F.min("next_attempt").alias("due"))
