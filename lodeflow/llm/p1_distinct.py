"""Problem 1: distinct accounts per day, category, token and every combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.text import normalised, spread_nulls
from lodeflow.llm import bitmaps
from lodeflow.plans.ledger import DAYS_SQL, transaction_days
from lodeflow.session import stored
from lodeflow.sources.tables import table

DIMS = ["day", "category", "token_sid"]
ROLES = {"spender": "n_spenders", "receiver": "n_receivers"}


def members(spark: SparkSession, d: str) -> DataFrame:
    """day, category, token_sid, role, account: distinct. A transfer without a known block has the day NULL."""
    t = table(spark, d, "abstract_token_transfer", "tx_sid", "category", "token_sid", "spender_address_sid", "receiver_address_sid")
    t = t.select(normalised("tx_sid").alias("tx_sid"), "category", normalised("token_sid").alias("token_sid"), F.array(*[F.struct(F.lit(r).alias("role"), normalised(f"{r}_address_sid").alias("account")) for r in ROLES]).alias("_a"))
    t = t.withColumn("tx_sid", spread_nulls("tx_sid", "_a"))
    dated = t.join(transaction_days(spark, d), "tx_sid", "left").withColumn("day", F.date_from_unix_date("day_no"))
    return dated.select(*DIMS, F.inline("_a")).where("account IS NOT NULL").distinct()


def words(spark: SparkSession, d: str) -> DataFrame:
    # Stored: the members make the dictionary and are then coded by it.
    m = stored(members(spark, d), "members")
    return bitmaps.build(m, [*DIMS, "role"], "account", bitmaps.encode(m.select("account")))


def p1_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.cube_counts(words(spark, d), DIMS, "role", ROLES).withColumn("error_bound", F.lit(bitmaps.ERROR_BOUND))


def p1_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable state: containers per day, category, token and role."""
    return bitmaps.pack(words(spark, d), [*DIMS, "role"])


def p1_bitmap_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the containers of the state hold, unpacked and counted bit by bit, per group."""
    groups = [*DIMS, "role"]
    return bitmaps.count(bitmaps.unpack(p1_bitmaps(spark, d), groups), groups, "n_accounts")


def by_day(spark: SparkSession, d: str) -> DataFrame:
    """Containers per day and role: those of p1_bitmaps merged by OR."""
    return bitmaps.merge(p1_bitmaps(spark, d), ["day", "role"])


def p1_both_roles(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that spend and receive on the same day: the AND of two sets."""
    return bitmaps.packed_count(bitmaps.merge(by_day(spark, d), ["day"], at_least=len(ROLES)), ["day"], "n_accounts")


def p1_trailing_week(spark: SparkSession, d: str) -> DataFrame:
    """Distinct accounts of the seven days up to each day with transfers, by role: the OR of days."""
    w = stored(by_day(spark, d).where("day IS NOT NULL"), "days")
    days = w.select("day").distinct()
    spread = w.select("container", "role", "data", F.explode(F.sequence("day", F.date_add("day", 6))).alias("day"))
    return bitmaps.packed_count(bitmaps.merge(spread.join(days, "day", "left_semi"), ["day", "role"]), ["day", "role"], "n_accounts")


_ROWS = f"""WITH {DAYS_SQL}, r AS (SELECT CAST(DATE '1970-01-01' + CAST(day_no AS INTEGER) AS DATE) AS day, category, lower(trim(token_sid)) AS token_sid, lower(trim(spender_address_sid)) AS s, lower(trim(receiver_address_sid)) AS v
  FROM abstract_token_transfer t LEFT JOIN tx_day x ON lower(trim(t.tx_sid)) = x.tx_sid)"""
_A = "a AS (SELECT DISTINCT day, 'spender' AS role, s AS k FROM r WHERE s IS NOT NULL UNION SELECT DISTINCT day, 'receiver', v FROM r WHERE v IS NOT NULL)"

QUERIES = {"p1_distinct_counts": p1_distinct_counts, "p1_bitmaps": p1_bitmaps, "p1_bitmap_counts": p1_bitmap_counts, "p1_both_roles": p1_both_roles, "p1_trailing_week": p1_trailing_week}
SQL = {
    "p1_distinct_counts": f"""{_ROWS} SELECT day, category, token_sid, CAST(1 - grouping(day) AS INTEGER) AS by_day, CAST(1 - grouping(category) AS INTEGER) AS by_category, CAST(1 - grouping(token_sid) AS INTEGER) AS by_token_sid,
  CAST(count(DISTINCT s) AS BIGINT) AS n_spenders, CAST(count(DISTINCT v) AS BIGINT) AS n_receivers, 0.0::DOUBLE AS error_bound FROM r WHERE s IS NOT NULL OR v IS NOT NULL GROUP BY CUBE (day, category, token_sid)""",
    "p1_bitmap_counts": f"{_ROWS} SELECT day, category, token_sid, role, CAST(count(DISTINCT k) AS BIGINT) AS n_accounts FROM (SELECT day, category, token_sid, 'spender' AS role, s AS k FROM r UNION ALL SELECT day, category, token_sid, 'receiver', v FROM r) WHERE k IS NOT NULL GROUP BY ALL",
    "p1_both_roles": f"{_ROWS}, {_A} SELECT day, CAST(count(*) AS BIGINT) AS n_accounts FROM (SELECT day, k FROM a GROUP BY day, k HAVING count(*) = 2) GROUP BY day",
    "p1_trailing_week": f"{_ROWS}, {_A} SELECT d.day, b.role, CAST(count(DISTINCT b.k) AS BIGINT) AS n_accounts FROM (SELECT DISTINCT day FROM a WHERE day IS NOT NULL) d JOIN a b ON b.day BETWEEN d.day - 6 AND d.day GROUP BY ALL",
}
