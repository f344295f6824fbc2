"""Document-shaped views of the driver's tables, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOXES = """boxes AS (
  SELECT l_orderkey AS page_id, box_id, l_returnflag AS label, l_quantity AS x0, y0, l_quantity + 5 + l_suppkey % 20 AS x1, y0 + 3 + 2 * l_linenumber AS y1
  FROM (SELECT *, CAST(l_partkey % 50 AS DOUBLE) AS y0,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS box_id FROM lineitem))"""
PRED = """pred AS (SELECT page_id, box_id, label, x0 + box_id % 3 AS x0, y0, x1 + box_id % 3 AS x1, y1 FROM boxes)"""
RUNS = """runs AS (
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, parts[ord] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS ord))"""
MANIFEST = """manifest AS (
  SELECT doc_id, sha256(text) AS sha, source, CASE WHEN doc_id % 24 < 12 THEN 'development' WHEN doc_id % 24 < 18 THEN 'validation' ELSE 'holdout' END AS split FROM documents)"""
LEDGER = """ledger AS (
  SELECT event_id, user_id % 3 AS provider, event_id % 2 AS variant, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS status, value AS duration_ms, event_type FROM events)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of pages, numbered in a total order of each page's lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    y0 = (F.col("l_partkey") % 50).cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.row_number().over(order).cast("long").alias("box_id"), F.col("l_returnflag").alias("label"),
        F.col("l_quantity").alias("x0"), y0.alias("y0"), (F.col("l_quantity") + 5 + F.col("l_suppkey") % 20).alias("x1"), (y0 + 3 + 2 * F.col("l_linenumber")).alias("y1"),
    )


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """The boxes, moved to the right by 0 to 2."""
    shift = F.col("box_id") % 3
    return boxes(spark, d).withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift})


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, from 1."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("ord"), "text")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as dataset items with a content hash and a split."""
    part = F.col("doc_id") % 24
    split = F.when(part < 12, "development").when(part < 18, "validation").otherwise("holdout")
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "source", split.alias("split"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to providers."""
    status = F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE")
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("provider"), (F.col("event_id") % 2).alias("variant"), status.alias("status"), F.col("value").alias("duration_ms"), "event_type")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")
