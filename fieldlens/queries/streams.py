"""Queries that run a stream over what is there; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens import streaming
from fieldlens.registry import query


def log_stream(spark: SparkSession, d: str) -> DataFrame:
    raw = streaming.stream_table(spark, d, "events")
    return raw.select(F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("logged_at"), F.col("event_id").alias("record_id"), "value")


@query("q_stream_latest", "SELECT subject, kind, value FROM status_log QUALIFY row_number() OVER (PARTITION BY subject, kind ORDER BY logged_at DESC, record_id DESC) = 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return streaming.run_available(streaming.latest_states(log_stream(spark, d)), "complete")


@query("q_stream_windows", "SELECT CAST(date_trunc('day', logged_at) AS DATE) AS day, kind, count(*) AS n, round(sum(value), 4) AS total FROM status_log GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    got = streaming.run_available(streaming.windowed_counts(log_stream(spark, d)), "complete")
    return got.select(F.to_date("w.start").alias("day"), "kind", "n", F.round("total", 4).alias("total"))
