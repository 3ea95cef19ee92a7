"""The edge list of transfers with their block's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.text import spread_nulls
from lodeflow.functions.uint256 import at_least, digits
from lodeflow.schemas import BLACKLIST, MIN_AMOUNT


def _joined(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """left with right's columns, by a left join on key; left's rows without a key are spread by another column, as they match nothing and needn't meet."""
    k = spread_nulls(key, by)
    return left.withColumn("_k", k).join(right.withColumnRenamed(key, "_k"), "_k", "left").drop("_k")


def edgelist(transfers: DataFrame, transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """transfer_sid, from_address_sid, to_address_sid, amount, token_sid, tx_sid, timestamp: two left joins.

    A transfer without a transaction or block keeps its row with a NULL
    timestamp; a key with several rows on the right repeats the transfer.
    """
    dated = _joined(_joined(transfers, transactions.select("tx_sid", "block_sid"), "tx_sid", "transfer_sid"), blocks.select("block_sid", "timestamp"), "block_sid", "transfer_sid")
    return dated.select("transfer_sid", F.col("spender_address_sid").alias("from_address_sid"), F.col("receiver_address_sid").alias("to_address_sid"), "amount", "token_sid", "tx_sid", "timestamp")


def unmatched(transfers: DataFrame, transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: transfers, those without a transaction, those whose transaction has no block."""
    tx = transactions.select("tx_sid", "block_sid").withColumn("_tx", F.lit(True))
    j = _joined(_joined(transfers.select("tx_sid", "transfer_sid"), tx, "tx_sid", "transfer_sid"), blocks.select("block_sid").withColumn("_block", F.lit(True)), "block_sid", "transfer_sid")
    return j.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_tx").isNull()).alias("without_tx"), F.count_if(F.col("_tx").isNotNull() & F.col("_block").isNull()).alias("without_block"))


def dropped_amounts(transfers: DataFrame) -> DataFrame:
    """One row: transfers, those whose amount is no whole number of at most 78 digits (filter_edges drops them), those of more than 38 digits (kept exactly)."""
    d = digits("amount")
    return transfers.agg(F.count("*").alias("n_rows"), F.count_if(d.isNull()).alias("without_amount"), F.count_if(F.length(d) > 38).alias("beyond_38_digits"))


def filter_edges(edges: DataFrame, min_amount: int = MIN_AMOUNT, blacklist: tuple[str, ...] = BLACKLIST) -> DataFrame:
    """Without amounts below the minimum or accounts of the blacklist; a NULL account is on no list.

    amount stays text, as plain digits of up to 78 places, and is compared
    exactly; rows whose amount is no such number are dropped (dropped_amounts counts them).
    """
    listed = F.coalesce(F.col("from_address_sid").isin(*blacklist), F.lit(False)) | F.coalesce(F.col("to_address_sid").isin(*blacklist), F.lit(False))
    return edges.withColumn("amount", digits("amount")).where(at_least(F.col("amount"), min_amount) & ~listed)
