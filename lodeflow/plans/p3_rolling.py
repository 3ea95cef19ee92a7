"""Problem 3: trailing totals per spender and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import uint256
from lodeflow.functions.text import normalised
from lodeflow.operators.first_copy import first_copy
from lodeflow.operators.rolling import trailing_totals
from lodeflow.plans.ledger import DAYS_SQL, day_bounds, transaction_days
from lodeflow.sources.tables import table

PERIODS = (7, 30)


def daily_totals(spark: SparkSession, d: str) -> DataFrame:
    """spender_address_sid, day_no, n, limbs: sparse, each transfer_sid once (its earliest row), by block day.

    Transfers without a known block have no day and are left out, as are those
    without a spender; an amount that is no number adds nothing but counts in n.
    """
    t = table(spark, d, "abstract_token_transfer", "transfer_sid", "amount", "tx_sid", "spender_address_sid", "ingested_at")
    t = t.select("transfer_sid", "ingested_at", normalised("spender_address_sid").alias("spender_address_sid"), normalised("tx_sid").alias("tx_sid"), uint256.digits("amount").alias("amount"))
    once = first_copy(t, normalised("transfer_sid"), ["ingested_at", "spender_address_sid", "tx_sid", "amount"], ["spender_address_sid", "tx_sid", "amount"])
    dated = once.where("spender_address_sid IS NOT NULL AND tx_sid IS NOT NULL").join(transaction_days(spark, d), "tx_sid")
    limbs = dated.select("spender_address_sid", "day_no", *[F.coalesce(x, F.lit(0)).cast("decimal(27,0)").alias(n) for x, n in zip(uint256.split(F.col("amount")), uint256.LIMBS, strict=True)])
    return limbs.groupBy("spender_address_sid", "day_no").agg(F.count("*").alias("n"), *uint256.sums())


def p3_trailing_totals(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(daily_totals(spark, d), "spender_address_sid", PERIODS, *day_bounds(spark, d))


_TEXT = """CASE WHEN {h} IS NULL THEN NULL WHEN {h} = 0 AND {m} = 0 THEN CAST({l} AS VARCHAR) ELSE regexp_replace(
  concat(CAST({h} + ({m} + {l} // B) // B AS VARCHAR), lpad(CAST(({m} + {l} // B) % B AS VARCHAR), 27, '0'), lpad(CAST({l} % B AS VARCHAR), 27, '0')), '^0+([0-9])', '\\1') END""".replace("B", "CAST('1000000000000000000000000000' AS HUGEINT)")


def _text(p: str) -> str:
    return _TEXT.format(h=f"hi{p}", m=f"mi{p}", l=f"lo{p}")


#: Limbs of an amount in SQL; `a` is the digit text.
LIMBS_SQL = "CAST(substr(lpad(a, 81, '0'), 1, 27) AS HUGEINT) AS hi, CAST(substr(lpad(a, 81, '0'), 28, 27) AS HUGEINT) AS mi, CAST(substr(lpad(a, 81, '0'), 55, 27) AS HUGEINT) AS lo"
DIGITS_SQL = "CASE WHEN regexp_matches(trim(amount), '^[0-9]+$') AND length(regexp_replace(trim(amount), '^0+([0-9])', '\\1')) <= 78 THEN regexp_replace(trim(amount), '^0+([0-9])', '\\1') END"

_WINDOW = ", ".join(f"CAST(sum(n) OVER w{p} AS BIGINT) AS n{p}, CAST(sum(hi) OVER w{p} AS HUGEINT) AS hi{p}, CAST(sum(mi) OVER w{p} AS HUGEINT) AS mi{p}, CAST(sum(lo) OVER w{p} AS HUGEINT) AS lo{p}" for p in PERIODS)
_OUT = ", ".join(f"n{p} AS n_{p}d, {_text(str(p))} AS total_{p}d, CAST({_text(str(p))} AS DOUBLE) / {p}.0::DOUBLE AS avg_{p}d" for p in PERIODS)

P3_SQL = f"""WITH {DAYS_SQL},
once AS (SELECT s, x, a FROM (SELECT lower(trim(spender_address_sid)) AS s, lower(trim(tx_sid)) AS x, {DIGITS_SQL} AS a,
    row_number() OVER (PARTITION BY lower(trim(transfer_sid)) ORDER BY ingested_at NULLS FIRST, lower(trim(spender_address_sid)) NULLS FIRST, lower(trim(tx_sid)) NULLS FIRST, ({DIGITS_SQL}) NULLS FIRST) AS rn
  FROM abstract_token_transfer WHERE transfer_sid IS NOT NULL) WHERE rn = 1 AND s IS NOT NULL),
limbs AS (SELECT s, day_no, {LIMBS_SQL} FROM once JOIN tx_day ON x = tx_sid),
daily AS (SELECT s, day_no, count(*) AS n, sum(coalesce(hi, 0)) AS hi, sum(coalesce(mi, 0)) AS mi, sum(coalesce(lo, 0)) AS lo FROM limbs GROUP BY ALL),
bounds AS (SELECT min("timestamp") // 86400 AS d0, max("timestamp") // 86400 AS d1 FROM abstract_block),
cal AS (SELECT DISTINCT s, unnest(range(d0, d1 + 1)) AS day_no FROM daily, bounds),
filled AS (SELECT s, day_no, coalesce(n, 0) AS n, coalesce(hi, 0) AS hi, coalesce(mi, 0) AS mi, coalesce(lo, 0) AS lo FROM cal LEFT JOIN daily USING (s, day_no)),
rolled AS (SELECT s, day_no, {_WINDOW} FROM filled WINDOW {", ".join(f"w{p} AS (PARTITION BY s ORDER BY day_no RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW)" for p in PERIODS)})
SELECT s AS spender_address_sid, CAST(DATE '1970-01-01' + CAST(day_no AS INTEGER) AS DATE) AS day, {_OUT} FROM rolled"""

QUERIES = {"p3_trailing_totals": p3_trailing_totals}
SQL = {"p3_trailing_totals": P3_SQL}
