"""Problem 6: per-account results although a few accounts own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeflow.functions.text import normalised
from lodeflow.operators.tree_aggregate import account_totals, heavy_keys
from lodeflow.plans.p3_rolling import _TEXT, DIGITS_SQL, LIMBS_SQL
from lodeflow.sources.tables import table

SHARE = 0.02


def p6_account_totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "abstract_token_transfer", "spender_address_sid", "receiver_address_sid", "amount")
    t = t.select("amount", normalised("spender_address_sid").alias("s"), normalised("receiver_address_sid").alias("r"))
    return account_totals(t, {"spender": ("s", "r"), "receiver": ("r", "s")}, "amount")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n_all = table(spark, d, "abstract_token_transfer").count()
    return heavy_keys(p6_account_totals(spark, d), n_all, SHARE).select("role", "account_sid")


_ROWS = "SELECT 'spender' AS role, lower(trim(spender_address_sid)) AS k, lower(trim(receiver_address_sid)) AS o, amount FROM abstract_token_transfer UNION ALL SELECT 'receiver', lower(trim(receiver_address_sid)), lower(trim(spender_address_sid)), amount FROM abstract_token_transfer"

P6_SQL = f"""WITH r AS ({_ROWS}), x AS (SELECT role, k, o, {DIGITS_SQL} AS a FROM r), y AS (SELECT role, k, o, a, {LIMBS_SQL} FROM x),
z AS (SELECT role, k, count(*) AS n, count(a) AS na, count(DISTINCT o) AS d, CAST(sum(hi) AS HUGEINT) AS h, CAST(sum(mi) AS HUGEINT) AS m, CAST(sum(lo) AS HUGEINT) AS l FROM y GROUP BY role, k)
SELECT role, k AS account_sid, CAST(n AS BIGINT) AS n_rows, CAST(na AS BIGINT) AS n_amounts, {_TEXT.format(h="h", m="m", l="l")} AS total_amount, CAST(d AS BIGINT) AS n_counterparties FROM z"""

P6_FOUND_SQL = f"WITH r AS ({_ROWS}) SELECT role, k AS account_sid FROM r WHERE k IS NOT NULL GROUP BY role, k HAVING count(*) >= {SHARE} * (SELECT count(*) FROM abstract_token_transfer)"

QUERIES = {"p6_found": p6_found, "p6_account_totals": p6_account_totals}
SQL = {"p6_found": P6_FOUND_SQL, "p6_account_totals": P6_SQL}
