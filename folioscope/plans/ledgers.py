"""Queries of the streaming operators run as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import ledger as ops
from .views import ledger, table


def timed(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).join(table(spark, d, "events").select("event_id", "ts"), "event_id")


def stream_durations(spark: SparkSession, d: str) -> DataFrame:
    found = ops.windowed_durations(timed(spark, d), "ts", "1 hour", "1 day", "provider")
    return found.select("start", "provider", "n", "failed", "min_ms", "max_ms")


def stream_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = timed(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    return ops.admitted(rows, "ts", "1 day", "provider", "variant", "day").groupBy("provider", "variant").agg(F.count("*").alias("n"))


QUERIES = [stream_durations, stream_admission]

ORACLES = {
    "stream_durations": "SELECT date_trunc('day', ts) AS start, user_id % 3 AS provider, count(*) FILTER (WHERE event_type <> 'error') AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, min(value) FILTER (WHERE event_type <> 'error') AS min_ms, max(value) FILTER (WHERE event_type <> 'error') AS max_ms FROM events GROUP BY ALL",
    "stream_admission": "SELECT provider, variant, count(*) AS n FROM (SELECT DISTINCT user_id % 3 AS provider, event_id % 2 AS variant, date_trunc('day', ts) AS day FROM events) GROUP BY ALL",
}
