"""Dates and first copies of the ledger tables, shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.text import normalised
from lodeflow.operators.first_copy import first_copy
from lodeflow.sources.tables import table

SECONDS_A_DAY = 86400


def block_days(spark: SparkSession, d: str) -> DataFrame:
    """block_sid (normalised), day_no: the day of each block by its earliest row."""
    b = table(spark, d, "abstract_block", "block_sid", "timestamp", "ingested_at").where("timestamp IS NOT NULL")
    return first_copy(b, normalised("block_sid"), ["ingested_at", "timestamp"], ["timestamp"]).select(F.col("_key").alias("block_sid"), F.floor(F.col("timestamp") / SECONDS_A_DAY).cast("int").alias("day_no"))


def transaction_days(spark: SparkSession, d: str) -> DataFrame:
    """tx_sid (normalised), day_no: only transactions whose block is known."""
    t = table(spark, d, "abstract_transaction", "tx_sid", "block_sid", "ingested_at").withColumn("block_sid", normalised("block_sid")).where("block_sid IS NOT NULL")
    return first_copy(t, normalised("tx_sid"), ["ingested_at", "block_sid"], ["block_sid"]).withColumnRenamed("_key", "tx_sid").join(block_days(spark, d), "block_sid").select("tx_sid", "day_no")


def day_bounds(spark: SparkSession, d: str) -> tuple[int, int]:
    """First and last day number of the blocks (two numbers, from one small scan); (0, -1) without blocks."""
    r = table(spark, d, "abstract_block", "timestamp").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    return (0, -1) if r.a is None else (r.a // SECONDS_A_DAY, r.b // SECONDS_A_DAY)


#: The same in SQL: block_day(block_sid, day_no) and tx_day(tx_sid, day_no).
DAYS_SQL = """
block_day AS (SELECT k AS block_sid, ts // 86400 AS day_no FROM (
  SELECT lower(trim(block_sid)) AS k, "timestamp" AS ts, row_number() OVER (PARTITION BY lower(trim(block_sid)) ORDER BY ingested_at NULLS FIRST, "timestamp") AS rn
  FROM abstract_block WHERE "timestamp" IS NOT NULL AND block_sid IS NOT NULL) WHERE rn = 1),
tx_day AS (SELECT k AS tx_sid, day_no FROM (
  SELECT lower(trim(tx_sid)) AS k, lower(trim(block_sid)) AS b, row_number() OVER (PARTITION BY lower(trim(tx_sid)) ORDER BY ingested_at NULLS FIRST, lower(trim(block_sid))) AS rn
  FROM abstract_transaction WHERE block_sid IS NOT NULL AND tx_sid IS NOT NULL) JOIN block_day ON b = block_sid WHERE rn = 1)
"""
