"""The transfer network of the test tables, step by step, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.operators import clean, edgelist, features, graph
from lodeflow.schemas import RAW_TRANSFER_COLUMNS
from lodeflow.session import stored
from lodeflow.sources.tables import spread, table

YEAR, MONTH = 2023, 1
FIRST_BLOCK, FIRST_TIME, BLOCK_SECONDS = 16_308_189, 1_672_531_199, 12

_MAPPING = f"""SELECT 1 AS chain_id,
  {FIRST_BLOCK} + CAST(floor(o_orderkey / 16) AS BIGINT) AS block_number,
  l_linenumber AS transfer_index,
  concat('0x', lpad(CAST(o_orderkey AS STRING), 64, '0')) AS transaction_hash,
  concat('0x', lpad(CAST(o_custkey AS STRING), 40, '0')) AS from_address,
  concat('0x', lpad(CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE 1000000 + l_suppkey END AS STRING), 40, '0')) AS to_address,
  concat('0x', lpad(lower(hex(CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000)), 64, '0')) AS value_binary"""


def raw_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Raw transfers made of order lines, all columns as text; stored, as raw files would be, so that no filter is pushed into their making."""
    lines, orders = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    joined = spread(lines, "l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return stored(spark.sql(_MAPPING + " FROM {joined}", joined=joined).select(*[F.col(c).cast("string").alias(c) for c in RAW_TRANSFER_COLUMNS]), "raw")


def blocks(transfers: DataFrame) -> DataFrame:
    n = F.col("block_number")
    return transfers.select("chain_id", "block_number").distinct().select("chain_id", "block_number", (F.lit(FIRST_TIME) + BLOCK_SECONDS * (n - FIRST_BLOCK)).cast("bigint").alias("timestamp"))


def filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    # Clean transfers are stored: three tables are made from them.
    t = stored(clean.clean_transfers(raw_transfers(spark, d)), "clean")
    edges = edgelist.edgelist(clean.abstract_transfer(t), clean.abstract_transaction(t), clean.abstract_block(blocks(t)))
    return edgelist.filter_edges(edges)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.aggregate_edges(filtered_edges(spark, d))


def whitelist(pairs_: DataFrame) -> DataFrame:
    """Addresses whose number is a multiple of 50 stand for infrastructure."""
    a = pairs_.select(F.explode(F.array("from_sid", "to_sid")).alias("s")).select(F.substring_index("s", "_", -1).alias("address")).distinct()
    return a.where(F.substring("address", 3, 40).cast("decimal(38,0)") % 50 == 0)


def network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, flagged vertices and numbered edges, each stored, as several steps need them."""
    p = stored(pairs(spark, d), "pairs")
    v = stored(graph.flag_infra(graph.number_vertices(p), whitelist(p)), "vertices")
    return p, v, stored(graph.numbered_edges(p, v), "edges")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    _, v, e = network(spark, d)
    return features.assemble(v, e, YEAR, MONTH)


#: The same in SQL, up to named CTEs: raw, tr (transfers), el (edge list), ed (pairs), vx (vertices), en (numbered), ei (without infrastructure).
NETWORK_SQL = f"""raw AS ({_MAPPING}, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_hash, transfer_index ORDER BY value_binary, from_address, to_address) AS rn FROM raw WHERE amount > 0) WHERE rn = 1),
el AS (SELECT concat('1_', transaction_hash, '_', CAST(transfer_index AS VARCHAR)) AS transfer_sid, concat('1_', from_address) AS f, concat('1_', to_address) AS t, amount, concat('1_', transaction_hash) AS tx_sid,
  {FIRST_TIME} + {BLOCK_SECONDS} * (block_number - {FIRST_BLOCK}) AS ts FROM tr WHERE amount >= 1000000000000
  AND right(from_address, 40) NOT IN (repeat('0', 40), concat(repeat('0', 36), 'dead'), repeat('e', 40)) AND right(to_address, 40) NOT IN (repeat('0', 40), concat(repeat('0', 36), 'dead'), repeat('e', 40))),
ed AS (SELECT f, t, CAST(sum(amount) AS HUGEINT) AS amount, count(*) AS cnt, min(ts) AS ts FROM el GROUP BY f, t),
po AS (SELECT f, t, row_number() OVER (ORDER BY f, t) AS i FROM ed),
vx AS (SELECT s AS sid, substr(s, 3) AS address, row_number() OVER (ORDER BY min(i)) - 1 AS node, CASE WHEN CAST(substr(s, 5) AS BIGINT) % 50 = 0 THEN 1 ELSE 0 END AS inf FROM (SELECT f AS s, 2 * i AS i FROM po UNION ALL SELECT t, 2 * i + 1 FROM po) GROUP BY s),
en AS (SELECT a.node AS src, b.node AS dst, a.inf AS si, b.inf AS di, amount, cnt FROM ed JOIN vx a ON f = a.sid JOIN vx b ON t = b.sid),
ei AS (SELECT src, dst, amount, cnt FROM en WHERE si = 0 AND di = 0)"""

NODE_SQL = """nf AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(ic) AS BIGINT) AS in_transfer_count, CAST(sum(oc) AS BIGINT) AS out_transfer_count, CAST(sum(ia) AS HUGEINT) AS total_input_amount, CAST(sum(oa) AS HUGEINT) AS total_output_amount, CAST(sum(ia) - sum(oa) AS HUGEINT) AS balance_proxy
  FROM (SELECT dst AS node, 1 AS i, 0 AS o, cnt AS ic, 0 AS oc, amount AS ia, 0 AS oa FROM en UNION ALL SELECT src, 0, 1, 0, cnt, 0, amount FROM en) GROUP BY node)"""
LOOPS_SQL = """lp AS (SELECT a.src AS node, CAST(max(CASE WHEN a.src = a.dst THEN 1 ELSE 0 END) AS BIGINT) AS self_loop_count, count(*) AS two_node_loop_count, CAST(sum(a.amount + b.amount) AS HUGEINT) AS two_node_loop_amount, CAST(sum(a.cnt + b.cnt) AS BIGINT) AS two_node_loop_tx_count
  FROM ei a JOIN ei b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"""


def cycles_sql(condition: str) -> str:
    return f"""cy AS (SELECT a.src AS u, b.src AS w, c.src AS v, a.amount + b.amount + c.amount AS amount, a.cnt + b.cnt + c.cnt AS cnt FROM ei a JOIN ei b ON a.dst = b.src JOIN ei c ON b.dst = c.src AND c.dst = a.src WHERE {condition}),
tl AS (SELECT node, count(*) AS triangle_loop_count, CAST(sum(amount) AS HUGEINT) AS triangle_loop_amount, CAST(sum(cnt) AS BIGINT) AS triangle_loop_tx_count FROM (SELECT u AS node, amount, cnt FROM cy UNION ALL SELECT w, amount, cnt FROM cy UNION ALL SELECT v, amount, cnt FROM cy) GROUP BY node)"""


ORDERED, ANY = "a.src < b.src AND b.src < c.src", "a.src < b.src AND a.src < c.src AND b.src <> c.src"
EGO_SQL = """nb AS (SELECT DISTINCT c, o FROM (SELECT src AS c, dst AS o FROM ei UNION ALL SELECT dst, src FROM ei)), mb AS (SELECT c, o FROM nb UNION SELECT c, c FROM nb),
eg AS (SELECT n.c AS node, n.k AS egonet_node_count, CAST(coalesce(m.k, 0) AS BIGINT) AS egonet_edge_count, CASE WHEN n.k > 1 THEN coalesce(m.k, 0)::DOUBLE / (n.k * (n.k - 1)) ELSE 0.0 END AS egonet_density
  FROM (SELECT c, count(*) AS k FROM mb GROUP BY c) n LEFT JOIN (SELECT x.c, count(*) AS k FROM mb x JOIN ei e ON x.o = e.src JOIN mb y ON y.c = x.c AND y.o = e.dst WHERE e.src <> e.dst GROUP BY x.c) m ON n.c = m.c)"""

_SHOWN = lambda c, t, z: f"CASE WHEN inf = 0 THEN CAST(coalesce({c}, {z}) AS {t}) END AS {c}"
FEATURES_SQL = f"""{NETWORK_SQL}, {NODE_SQL}, {LOOPS_SQL}, {cycles_sql(ORDERED)}, {EGO_SQL},
ft AS (SELECT node, address, inf AS is_infra, 1 AS chain_id, {YEAR} AS year, {MONTH} AS month, {", ".join(_SHOWN(c, t, z) for c, t, z in (
    ("in_degree", "BIGINT", 0), ("out_degree", "BIGINT", 0), ("in_transfer_count", "BIGINT", 0), ("out_transfer_count", "BIGINT", 0), ("total_input_amount", "HUGEINT", 0), ("total_output_amount", "HUGEINT", 0), ("balance_proxy", "HUGEINT", 0),
    ("self_loop_count", "BIGINT", 0), ("two_node_loop_count", "BIGINT", 0), ("two_node_loop_amount", "DOUBLE", 0), ("two_node_loop_tx_count", "BIGINT", 0), ("triangle_loop_count", "BIGINT", 0), ("triangle_loop_amount", "DOUBLE", 0), ("triangle_loop_tx_count", "BIGINT", 0),
    ("egonet_node_count", "BIGINT", 1), ("egonet_edge_count", "BIGINT", 0), ("egonet_density", "DOUBLE", 0.0)))}
  FROM vx LEFT JOIN nf USING (node) LEFT JOIN lp USING (node) LEFT JOIN tl USING (node) LEFT JOIN eg USING (node))"""  # fmt: skip
