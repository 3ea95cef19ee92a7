"""Problem 4: messages delivered more than once."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.text import normalised, whole_number_text
from lodeflow.session import shared_dir
from lodeflow.sources.tables import table
from lodeflow.streaming.exactly_once import Deduplicated, deduplicate

#: Copies further apart than this go through the look-up.
DELAY_SECONDS = 10 * 86400
#: Micro-batches of a run, at least, and the input of one, at most.
BATCHES, BATCH_BYTES = 12, 4 << 30
FILE_BYTES = 128 << 20


def native_key() -> Column:
    """chain_id, transaction_hash and transfer_index of a raw native transfer; chain_id 1 if NULL. NULL without hash or index."""
    chain = F.coalesce(whole_number_text("chain_id"), F.lit("1"))
    return F.concat(chain, F.lit("_"), normalised("transaction_hash"), F.lit("_"), whole_number_text("transfer_index"))


def arrivals(spark: SparkSession, d: str, name: str, key: Column, event_time: str, order: str | None, payload: list[str]) -> tuple[DataFrame, int]:
    """The table as a stream of files in the order of arrival, some for each micro-batch; and the bytes of a batch.

    The table is written once, ranged by arrival (unknown times last), and its
    files are dated in that order, as the file source reads by date. Where a
    file system ignores such dates, batches may come in another order; each
    identifier still comes out once.
    """
    rows = table(spark, d, name)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    batches = max(BATCHES, -(-size // BATCH_BYTES))
    files = max(1, -(-size // batches // FILE_BYTES))
    order = F.unix_micros(F.col(event_time).cast("timestamp")) if order is None else F.col(order)
    rows = rows.select(key.alias("key"), F.col(event_time).alias("at"), order.alias("order"), *[F.col(c).alias(f"p_{c}") for c in payload]).where("key IS NOT NULL")
    path = shared_dir(spark, f"arrivals-{name}")
    rows.repartitionByRange(batches * files, F.col("at").asc_nulls_last(), F.col("order").asc_nulls_last(), F.xxhash64("key")).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for i, (_, p) in enumerate(found):
        fs.setTimes(p, 1_000_000_000_000 + 1000 * i, -1)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "part-*").parquet(path), size // batches


def run(spark: SparkSession, d: str, name: str, key: Column, event_time: str, order: str | None, payload: list[str]) -> Deduplicated:
    """Stream one table through the operator, in micro-batches by arrival."""
    stream, batch_bytes = arrivals(spark, d, name, key, event_time, order, payload)
    stream = stream.withColumnsRenamed({f"p_{c}": c for c in payload})
    # A shard's part of a batch and its state stay small whatever the size of the table.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batch_bytes // (4 << 20))
    return deduplicate(stream, F.col("key"), "at", "order", payload, shared_dir(spark, f"dedup-{name}"), DELAY_SECONDS, shards)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Both streams run side by side, as each waits for its batches one after the other."""
    ledger = lambda: run(spark, d, "abstract_token_transfer", normalised("transfer_sid"), "ingested_at", None, [])
    raw = lambda: run(spark, d, "raw_native_transfer", native_key(), "delivered_at", "delivery_id", [])
    with ThreadPoolExecutor(2) as pool:
        results = [pool.submit(f) for f in (ledger, raw)]
    named = [r.result().repeated.select(F.lit(t).alias("table_name"), F.col("_key").alias("transfer_sid")) for r, t in zip(results, ("abstract_token_transfer", "raw_native_transfer"), strict=True)]
    return named[0].unionByName(named[1])


RAW = ["delivery_id", "block_number", "transaction_hash", "from_address", "to_address", "value_binary"]


def p4_native_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Each raw native transfer once: its earliest delivery."""
    return run(spark, d, "raw_native_transfer", native_key(), "delivered_at", "delivery_id", RAW).rows.withColumnRenamed("_key", "transfer_sid")


def p4_ledger_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Each transfer_sid of the ledger once, with the time at which it first came."""
    return run(spark, d, "abstract_token_transfer", normalised("transfer_sid"), "ingested_at", None, ["ingested_at"]).rows.withColumnRenamed("_key", "transfer_sid")


_NUMBER = "CASE WHEN regexp_matches(trim({0}), '^[0-9]+$') THEN regexp_replace(trim({0}), '^0+([0-9])', '\\1') ELSE lower(trim({0})) END"
_KEY = f"concat(coalesce({_NUMBER.format('chain_id')}, '1'), '_', lower(trim(transaction_hash)), '_', {_NUMBER.format('transfer_index')})"
_KEYED = f"SELECT {_KEY} AS k, * FROM raw_native_transfer WHERE transaction_hash IS NOT NULL AND transfer_index IS NOT NULL"

QUERIES = {"p4_found": p4_found, "p4_native_transfers": p4_native_transfers, "p4_ledger_transfers": p4_ledger_transfers}
SQL = {
    "p4_found": f"""SELECT 'abstract_token_transfer' AS table_name, lower(trim(transfer_sid)) AS transfer_sid FROM abstract_token_transfer WHERE transfer_sid IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'raw_native_transfer', k FROM ({_KEYED}) GROUP BY k HAVING count(*) > 1""",
    "p4_native_transfers": f"SELECT k AS transfer_sid, {', '.join(RAW)} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY delivered_at, delivery_id) AS rn FROM ({_KEYED})) WHERE rn = 1",
    "p4_ledger_transfers": "SELECT lower(trim(transfer_sid)) AS transfer_sid, min(ingested_at) AS ingested_at FROM abstract_token_transfer WHERE transfer_sid IS NOT NULL GROUP BY 1",
}
