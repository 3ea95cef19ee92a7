"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.mixing import mix, report
from lodeflow.llm.tokens import count_tokens
from lodeflow.session import ensure_checkpoint_dir
from lodeflow.sources.tables import spread, table


def _items(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return count_tokens(spread(table(spark, d, "documents", "doc_id", "source", "text"), "doc_id"), keep=("source",))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_items(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, per source."""
    items, targets = _items(spark, d).checkpoint(), table(spark, d, "mix_targets")
    return report(mix(items, targets).checkpoint(), items, targets)


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
