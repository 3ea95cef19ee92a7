"""Problem 10: personal information inside free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.pii import find_all, redact
from lodeflow.sources.tables import spread, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_all(_documents(spark, d)).drop("end_char")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders for personal information."""
    return redact(_documents(spark, d))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
