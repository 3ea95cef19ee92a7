"""The directed transfer graph: aggregated edges, numbered vertices, and views without infrastructure accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.uint256 import LIMBS, limbs, split, sums, to_text
from lodeflow.operators.order import running_total


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """from_sid, to_sid, the limbs of the summed amount, count, first_timestamp, token_sid: one row per pair of accounts. NULL ends are left out.

    edges: as filter_edges gives them. with_amounts() writes limbs as text.
    """
    rows = edges.where("from_address_sid IS NOT NULL AND to_address_sid IS NOT NULL")
    rows = rows.select(F.col("from_address_sid").alias("from_sid"), F.col("to_address_sid").alias("to_sid"), *split(F.col("amount")), "transfer_sid", "timestamp", "token_sid")
    return rows.groupBy("from_sid", "to_sid").agg(*sums(), F.count("transfer_sid").alias("count"), F.min("timestamp").alias("first_timestamp"), F.min("token_sid").alias("token_sid"))


def with_amounts(df: DataFrame) -> DataFrame:
    """The limb columns as one column amount, exact digits as text, in their place."""
    return df.select(*[to_text(*limbs()).alias("amount") if c == LIMBS[0] else F.col(c) for c in df.columns if c not in LIMBS[1:]])


def number_vertices(pairs: DataFrame) -> DataFrame:
    """sid, address, node: numbers in the order in which accounts first appear in the sorted edges (from before to).

    Where an account appears first is the smallest (from, to, side) it takes
    part in, a plain minimum; only the vertices are then sorted.
    """
    ends = pairs.select("from_sid", "to_sid", F.explode(F.array(F.struct(F.col("from_sid").alias("sid"), F.lit(0).alias("side")), F.struct(F.col("to_sid").alias("sid"), F.lit(1).alias("side")))).alias("_e"))
    first = ends.groupBy("_e.sid").agg(F.min(F.struct("from_sid", "to_sid", "_e.side")).alias("_first"))
    order = [F.col("_first.from_sid"), F.col("_first.to_sid"), F.col("_first.side")]
    return running_total(first, order, before="node").select("sid", F.lower(F.substring_index("sid", "_", -1)).alias("address"), "node")


def flag_infra(vertices: DataFrame, whitelist: DataFrame) -> DataFrame:
    """vertices with is_infra (0 or 1). whitelist: addresses in its first column, in any case, with blanks."""
    listed = whitelist.select(F.lower(F.btrim(F.col(whitelist.columns[0]))).alias("address")).where("address IS NOT NULL").distinct().withColumn("_listed", F.lit(1))
    return vertices.join(listed, "address", "left").withColumn("is_infra", F.coalesce("_listed", F.lit(0))).drop("_listed")


def numbered_edges(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """src, dst, src_infra, dst_infra, the limbs of the amount, count."""
    v = vertices.select("sid", "node", "is_infra")
    s = v.select(F.col("sid").alias("from_sid"), F.col("node").alias("src"), F.col("is_infra").alias("src_infra"))
    t = v.select(F.col("sid").alias("to_sid"), F.col("node").alias("dst"), F.col("is_infra").alias("dst_infra"))
    return pairs.join(s, "from_sid").join(t, "to_sid").select("src", "dst", "src_infra", "dst_infra", *LIMBS, "count")


def without_infra(edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are no infrastructure."""
    return edges.where("src_infra = 0 AND dst_infra = 0").select("src", "dst", *LIMBS, "count")


def infra_candidates(pairs: DataFrame, whitelist: DataFrame, k: int = 100) -> DataFrame:
    """The k accounts of highest total degree that aren't on the whitelist (as address or as sid); ties by sid."""
    ends = pairs.select(F.explode(F.array("from_sid", "to_sid")).alias("sid")).groupBy("sid").agg(F.count("*").alias("total_degree"))
    listed = whitelist.select(F.lower(F.btrim(F.col(whitelist.columns[0]))).alias("_a"))
    rest = ends.withColumn("address", F.lower(F.substring_index("sid", "_", -1))).join(listed, F.col("address") == F.col("_a"), "left_anti").join(listed, F.lower("sid") == F.col("_a"), "left_anti")
    return rest.orderBy(F.col("total_degree").desc(), "sid").limit(k)
