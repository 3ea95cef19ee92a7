"""Problem 2: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.operators.schema_drift import BLOCK_FIELDS, BYTES, DOUBLES, NUMBER_BYTES, NUMBERS, changes, consolidate
from lodeflow.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changes(table(spark, d, "raw_block_files", "feed", "file_seq", "record")).select("file_seq", "field", "change")


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All block records in the reference's raw block fields, one type and form each; other keys as one JSON text."""
    r = table(spark, d, "raw_block_files", "file_seq", "feed", "file_name", "record_no", "record")
    return consolidate(r).withColumn("other", F.to_json("other"))


def p2_block_values(spark: SparkSession, d: str) -> DataFrame:
    """The fields of p2_blocks as text, so that they compare across engines."""
    as_text = lambda f: (F.round(F.log10(f), 9).cast("string") if f in DOUBLES else F.col(f).cast("string")).alias(f)
    return p2_blocks(spark, d).select("file_seq", "feed", "record_no", *[as_text(f) for f in BLOCK_FIELDS])


def p2_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per feed, field and kind."""
    return changes(table(spark, d, "raw_block_files", "feed", "file_seq", "record")).groupBy("feed", "field", "change").agg(F.count("*").alias("n_changes"))


#: The spellings of the test tables, for the SQL only; the operator doesn't know them.
_SPELLINGS = {
    "base_fee_per_gas": "base_fee_per_gas BaseFeePerGas baseFeePerGas base_fee base_fee_wei basefee_per_gas bfpg", "chain_id": "chain_id chainId", "difficulty": "difficulty diff", "extra_data": "extra_data extraData", "gas_limit": "gas_limit gasLimit",
    "gas_used": "gas_used gasUsed", "mix_hash": "mix_hash prev_randao", "parent_hash": "parent_hash parentHash", "size": "size block_size", "state_root": "state_root stateRoot", "timestamp": "timestamp block_time ts",
    "total_difficulty_binary": "total_difficulty_binary td_binary totalDifficultyBinary total_difficulty_bin total_difficulty_bytes", "uncles_hash": "uncles_hash ommers_hash",
    "withdrawals_root": "withdrawals_root WithdrawalsRoot root_of_withdrawals wd_root withdrawalsRoot withdrawals_hash",
}
_JSON = ", ".join("coalesce(" + ", ".join(f"json_extract_string(record, '$.\"{k}\"')" for k in _SPELLINGS.get(f, f).split()) + f") AS \"{f}\"" for f in BLOCK_FIELDS)
_HEX_NUMBER = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower(substr({c}, 3)), ''), lambda x: (instr('0123456789abcdef', x) - 1)::HUGEINT)), lambda a, b: a * 16 + b)"
_NUMBER = f"CASE WHEN {{c}} LIKE '0x%' THEN {_HEX_NUMBER} WHEN regexp_full_match({{c}}, '[0-9]+') THEN CAST({{c}} AS HUGEINT) WHEN TRY_CAST({{c}} AS DOUBLE) < 1e15 THEN CAST(floor(CAST({{c}} AS DOUBLE)) AS HUGEINT) END"
_TEXT = "CASE WHEN {c} LIKE '[%' THEN array_to_string(from_json({c}, '[\"VARCHAR\"]'), '') WHEN {c} LIKE '0x%' THEN {c} WHEN regexp_full_match({c}, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AND NOT regexp_full_match({c}, '[0-9]+') THEN concat('0x', hex(from_base64({c}))) END"


def _value(f: str) -> str:
    c = f'"{f}"'
    if f in NUMBERS:
        return f"CAST({_NUMBER.format(c=c)} AS VARCHAR) AS {c}"
    if f in DOUBLES:
        return f"CAST(round(log10(CAST({c} AS DOUBLE)), 9) AS VARCHAR) AS {c}"
    if f in NUMBER_BYTES:
        digits = f"lower(substr(coalesce({_TEXT.format(c=c)}, '0x' || to_hex({_NUMBER.format(c=c)})), 3))"
        return f"'0x' || regexp_replace({digits}, '^0+(.)', '\\1') AS {c}"
    return f"lower({_TEXT.format(c=c)}) AS {c}" if f in BYTES else c


QUERIES = {"p2_found": p2_found, "p2_blocks": p2_blocks, "p2_block_values": p2_block_values, "p2_change_counts": p2_change_counts}
SQL = {"p2_block_values": f"SELECT file_seq, feed, record_no, {', '.join(_value(f) for f in BLOCK_FIELDS)} FROM (SELECT file_seq, feed, record_no, {_JSON} FROM raw_block_files)"}
