"""Per-key results where a few keys own most rows: multi-level tree aggregation.

Level 0 combines fixed-size input chunks where they lie (Spark's partial
aggregate of each scan split) into one state per (key, member). Further levels
merge states of a key in rounds of `fan_in`: members fall into leaf chunks by
hash, and each round joins `fan_in` neighbouring chunks of a key. No task gets
all partial states of a key, however hot it is, and the number of rounds is
the logarithm of the number of leaf chunks.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions import uint256


def tree_rounds(states: DataFrame, keys: list[str], merges: dict, leaves: int, fan_in: int) -> DataFrame:
    """Merge states (columns keys, _chunk and those of merges) to one per key.

    merges: result column -> aggregate Column over the state columns; it must
    give again a state of the same column, so that rounds can follow each other.
    """
    width = leaves
    while True:
        states = states.groupBy(*keys, "_chunk").agg(*[c.alias(k) for k, c in merges.items()])
        if width == 1:
            return states.drop("_chunk")
        width = -(-width // fan_in)
        states = states.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int") if width > 1 else F.lit(0))


def account_totals(rows: DataFrame, roles: dict[str, tuple[str, str]], amount: str, leaves: int | None = None, fan_in: int = 8) -> DataFrame:
    """role, account_sid, n_rows, n_amounts, total_amount, n_counterparties.

    roles: role -> (account column, counterparty column), already normalised.
    Every row counts, repeated ones too; a row without the account counts for
    the account NULL, so that counts add up to the table. An amount that is no
    whole number counts in n_rows only. total_amount is exact (text of up to
    78+ digits). n_counterparties: distinct non-null counterparties. The sum of
    an account without any valid amount is NULL. leaves: parts of an account at
    the first level; by default a few for each shuffle partition, so that the
    rounds grow with the logarithm of the size.
    """
    leaves = leaves or fan_in ** max(2, math.ceil(math.log(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in)))
    d = uint256.digits(amount)
    ends = F.array(*[F.struct(F.lit(r).alias("role"), F.col(a).alias("account_sid"), F.col(b).alias("_other")) for r, (a, b) in roles.items()])
    lines = rows.select(d.alias("_d"), F.explode(ends).alias("_e")).select("_e.*", F.col("_d").isNotNull().cast("long").alias("n_amounts"), *uint256.split(F.col("_d")))
    pairs = lines.groupBy("role", "account_sid", "_other").agg(F.count("*").alias("n_rows"), F.sum("n_amounts").alias("n_amounts"), *uint256.sums())
    leaf = pairs.withColumn("_chunk", F.pmod(F.xxhash64("_other"), F.lit(leaves)).cast("int")).withColumn("n_counterparties", F.col("_other").isNotNull().cast("long"))
    merges = {k: F.sum(k) for k in ("n_rows", "n_amounts", "n_counterparties")} | {k: F.sum(k).cast("decimal(38,0)") for k in uint256.LIMBS}
    done = tree_rounds(leaf.drop("_other"), ["role", "account_sid"], merges, leaves, fan_in)
    return done.select("role", "account_sid", "n_rows", "n_amounts", uint256.to_text(*[F.col(x) for x in uint256.LIMBS]).alias("total_amount"), "n_counterparties")


def heavy_keys(counts: DataFrame, n_all: int, share: float) -> DataFrame:
    """The rows of counts (with n_rows) whose key owns at least `share` of n_all rows; NULL keys are no keys."""
    least = math.ceil(Fraction(str(share)) * n_all)
    return counts.where((F.col("n_rows") >= F.lit(max(least, 1))) & F.col("account_sid").isNotNull())
