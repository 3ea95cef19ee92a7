"""Problem 5: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.sources.csv_rejects import COLUMNS, TOKENS, load_with_rejects, reason_sql, rejects, valid
from lodeflow.sources.tables import table


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_with_rejects(table(spark, d, "raw_transfer_lines", "line_id", "file_name", "line_no", "raw_line"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).where("reason IS NOT NULL").select("line_id", "reason")


def p5_transfers(spark: SparkSession, d: str) -> DataFrame:
    """The valid records as raw native transfers."""
    return valid(_loaded(spark, d))


def p5_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records per file and reason."""
    return rejects(_loaded(spark, d)).groupBy("file_name", "reason").agg(F.count("*").alias("n_records"))


_F = """(?:"(?:[^"]|"")*"|[^",]*)"""
_BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_PARSED = f"""l AS (SELECT line_id, file_name, coalesce(raw_line, '') AS r FROM raw_transfer_lines WHERE coalesce(line_no, 0) <> 1),
s AS (SELECT line_id, file_name, regexp_full_match(r, '(?s){_F}(?:,{_F})*') AS well, regexp_extract_all(concat(',', r), '(?s),({_F})', 1) AS f FROM l),
u AS (SELECT line_id, file_name, well, len(f) AS n, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM s),
v AS (SELECT line_id, file_name, well, n, {", ".join(f"lower(trim(f[{i + 1}], {_BLANK})) AS {c}" for i, c in enumerate(COLUMNS[:7]))} FROM u),
w AS (SELECT *, CASE WHEN NOT well THEN 'quoting' WHEN n <> 9 THEN 'column_count' ELSE {reason_sql()} END AS reason FROM v)"""

QUERIES = {"p5_found": p5_found, "p5_transfers": p5_transfers, "p5_reject_counts": p5_reject_counts}
SQL = {
    "p5_found": f"WITH {_PARSED} SELECT line_id, reason FROM w WHERE reason IS NOT NULL",
    "p5_transfers": f"""WITH {_PARSED} SELECT line_id, file_name, CAST(trunc(CAST(block_number AS DOUBLE)) AS BIGINT) AS block_number, regexp_replace(transfer_index, '^0+([0-9])', '\\1') AS transfer_index, transaction_hash, from_address, to_address, value_binary,
  CASE WHEN chain_id IN ({", ".join(f"'{t}'" for t in sorted(TOKENS))}) THEN '1' ELSE chain_id END AS chain_id FROM w WHERE reason IS NULL""",
    "p5_reject_counts": f"WITH {_PARSED} SELECT file_name, reason, count(*) AS n_records FROM w WHERE reason IS NOT NULL GROUP BY ALL",
}
