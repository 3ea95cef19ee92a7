"""Problem 8: texts in containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.packing import fill_report, pack
from lodeflow.llm.tokens import count_tokens
from lodeflow.sources.tables import spread, table


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(count_tokens(spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")), table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """The unused room per kind of container."""
    return fill_report(p8_containers(spark, d), table(spark, d, "container_sizes"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
