"""Clean blocks and transfers, and the five abstract tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import validate as V
from lodeflow.functions.text import normalised, null_tokens_to_null, number_or_null, trimmed
from lodeflow.functions.uint256 import hex_to_text
from lodeflow.operators.first_copy import first_copy
from lodeflow.schemas import NATIVE_TOKEN, RAW_BLOCK_COLUMNS, RAW_TRANSFER_COLUMNS, SCHEMAS


REQUIRED = RAW_TRANSFER_COLUMNS[:6]


def checked_transfers(raw: DataFrame, *keep: str) -> DataFrame:
    """The raw columns with reject_reason (NULL if valid), and the columns to keep along."""
    return raw.select(*RAW_TRANSFER_COLUMNS, V.first_reason(REQUIRED, V.transfer_checks()).alias("reject_reason"), *keep)


def clean_transfers(raw: DataFrame, *keep: str) -> DataFrame:
    """Valid transfers, normalised: block_number and transfer_index bigint, chain_id int, lower-case hashes and addresses."""
    lower = [normalised(c).alias(c) for c in ("transaction_hash", "from_address", "to_address", "value_binary")]
    return raw.where(V.all_of(V.transfer_checks())).select(V.block_number("block_number").alias("block_number"), trimmed("transfer_index").cast("bigint").alias("transfer_index"), *lower, trimmed(V.chain_id()).cast("int").alias("chain_id"), *keep)


def clean_blocks(raw: DataFrame) -> DataFrame:
    """Valid blocks, normalised; parent_hash may be NULL."""
    return raw.where(V.all_of(V.block_checks())).select(normalised("block_hash").alias("block_hash"), null_tokens_to_null("parent_hash").alias("parent_hash"), V.block_number("block_number").alias("block_number"), number_or_null("timestamp").cast("bigint").alias("timestamp"), trimmed(V.chain_id()).cast("int").alias("chain_id"))


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rows per reject reason; those kept under "kept"."""
    return checked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("n_rows"))


def checked_blocks(raw: DataFrame) -> DataFrame:
    """The raw block columns with reject_reason (NULL if valid)."""
    return raw.select(*RAW_BLOCK_COLUMNS, V.first_reason(("block_number", "block_hash", "timestamp"), V.block_checks()).alias("reject_reason"))


def drop_report(checked: DataFrame, stage: str) -> DataFrame:
    """stage, what, n_rows: rows read, kept, dropped for each reason, and kept with a block number whose fraction was cut off."""
    kept = F.col("reject_reason").isNull()
    n = checked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("what")).agg(F.count("*").alias("n"), F.count_if(kept & V.is_fraction("block_number")).alias("f"))
    rows = F.explode(F.array(F.struct("what", "n"), F.struct(F.lit("read").alias("what"), F.col("n")), F.struct(F.lit("fraction_cut_off").alias("what"), F.col("f").alias("n")))).alias("r")
    return n.select(rows).groupBy(F.lit(stage).alias("stage"), "r.what").agg(F.sum("r.n").alias("n_rows"))


def _sid(*parts: str):
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


def abstract_block(blocks: DataFrame) -> DataFrame:
    """block_sid, block_number, timestamp: distinct."""
    return blocks.select(_sid("chain_id", "block_number").alias("block_sid"), "block_number", "timestamp").distinct()


def abstract_transaction(transfers: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """tx_sid, tx_hash, block_sid: the first row of each transaction, by order, then block."""
    rows = transfers.select(_sid("chain_id", "transaction_hash").alias("tx_sid"), F.col("transaction_hash").alias("tx_hash"), _sid("chain_id", "block_number").alias("block_sid"), *order)
    return first_copy(rows, F.col("tx_sid"), [*order, "block_sid"], ["tx_hash", "block_sid"]).withColumnRenamed("_key", "tx_sid")


def abstract_transfer(transfers: DataFrame, order: tuple[str, ...] = ("value_binary", "from_address", "to_address")) -> DataFrame:
    """abstract_token_transfer: positive amounts, the first row of each transfer_sid by order.

    amount is the exact decimal number as text, of up to 78 digits.
    """
    rows = transfers.select("*", _sid("chain_id", "transaction_hash", "transfer_index").alias("_sid")).where(~F.col("value_binary").rlike("^0x0*$"))
    keep = ["transfer_index", "value_binary", "chain_id", "transaction_hash", "from_address", "to_address"]
    one = first_copy(rows, F.col("_sid"), list(order), keep)
    return one.select(
        F.col("_key").alias("transfer_sid"), "transfer_index", hex_to_text(F.col("value_binary")).alias("amount"), F.lit("transfer").alias("category"), _sid("chain_id", "transaction_hash").alias("tx_sid"),
        _sid("chain_id", "from_address").alias("spender_address_sid"), _sid("chain_id", "to_address").alias("receiver_address_sid"), F.concat_ws("_", "chain_id", F.lit("native")).alias("token_sid"),
    )


def abstract_account(transfers: DataFrame) -> DataFrame:
    """account_sid, address, type: the distinct ends of transfers, from one scan."""
    ends = transfers.select("chain_id", F.explode(F.array("from_address", "to_address")).alias("address")).distinct()
    return ends.select(_sid("chain_id", "address").alias("account_sid"), "address", F.lit("unknown").alias("type"))


def abstract_token(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([NATIVE_TOKEN], SCHEMAS["abstract_token"])
