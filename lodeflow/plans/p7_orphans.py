"""Problem 7: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.operators.orphans import Child, Parent, find_orphans, orphan_counts
from lodeflow.sources.tables import table


def orphans(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "removed_records", "table_name", "record_sid")
    removed = lambda name: gone.where(F.col("table_name") == name).select("record_sid")
    tx = Parent(table(spark, d, "abstract_transaction", "tx_sid", "ingested_at"), "tx_sid", "ingested_at", removed("abstract_transaction"))
    token = Parent(table(spark, d, "abstract_token", "token_sid", "ingested_at"), "token_sid", "ingested_at", table(spark, d, "removed_tokens", "token_sid"))
    block = Parent(table(spark, d, "abstract_block", "block_sid", "ingested_at"), "block_sid", "ingested_at", removed("abstract_block"))
    transfers = table(spark, d, "abstract_token_transfer", "transfer_sid", "tx_sid", "token_sid", "ingested_at")
    txs = table(spark, d, "abstract_transaction", "tx_sid", "block_sid", "ingested_at")
    return find_orphans(
        Child(transfers, "abstract_token_transfer", "transfer_sid", "ingested_at", {"tx_sid": tx, "token_sid": token}),
        Child(txs, "abstract_transaction", "tx_sid", "ingested_at", {"block_sid": block}),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spark, d).select("table_name", "record_sid", "ref_field", "status")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(orphans(spark, d))


def _sql(child: str, record: str, field: str, parent: str, key: str, removed: str) -> str:
    return f"""SELECT '{child}' AS table_name, r.record_sid, '{field}' AS ref_field, r.ref_sid, first_seen,
  CASE WHEN g.k IS NOT NULL THEN 'removed' WHEN p.k IS NULL THEN 'missing' WHEN p.t > f.first_seen THEN 'late' END AS status
FROM (SELECT DISTINCT lower(trim({record})) AS record_sid, lower(trim({field})) AS ref_sid FROM {child} WHERE {record} IS NOT NULL AND {field} IS NOT NULL) r
JOIN (SELECT lower(trim({record})) AS record_sid, min(ingested_at) AS first_seen FROM {child} GROUP BY 1) f USING (record_sid)
LEFT JOIN (SELECT lower(trim({key})) AS k, min(ingested_at) AS t FROM {parent} GROUP BY 1) p ON p.k = r.ref_sid
LEFT JOIN (SELECT DISTINCT lower(trim({removed.split()[0]})) AS k FROM {removed.partition(" ")[2]}) g ON g.k = r.ref_sid"""


_ALL = " UNION ALL ".join([
    _sql("abstract_token_transfer", "transfer_sid", "tx_sid", "abstract_transaction", "tx_sid", "record_sid removed_records WHERE table_name = 'abstract_transaction'"),
    _sql("abstract_token_transfer", "transfer_sid", "token_sid", "abstract_token", "token_sid", "token_sid removed_tokens"),
    _sql("abstract_transaction", "tx_sid", "block_sid", "abstract_block", "block_sid", "record_sid removed_records WHERE table_name = 'abstract_block'"),
])

QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
SQL = {
    "p7_found": f"SELECT table_name, record_sid, ref_field, status FROM ({_ALL}) WHERE status IS NOT NULL",
    "p7_counts": f"SELECT table_name, ref_field, status, CAST(first_seen AS DATE) AS period, count(*) AS n_orphans, count(DISTINCT ref_sid) AS n_keys FROM ({_ALL}) WHERE status IS NOT NULL GROUP BY ALL",
}
