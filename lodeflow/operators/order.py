"""Global ranks and running totals without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.session import stored


def running_total(df: DataFrame, order: list[Column], weight: Column | None = None, before: str = "before") -> DataFrame:
    """df with the total weight (number of rows, if none) of the rows before each one in the given order.

    Rows are range-partitioned and stored, so that partitions can't change
    under it; totals inside a partition start from the totals of
    the partitions ahead, of which there are as many as shuffle partitions. The
    order must be total for the result to be unique.
    """
    spark = df.sparkSession
    w = (F.lit(1) if weight is None else weight).cast("bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.withColumn("_w", w).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = placed.groupBy("_part").agg(F.sum("_w").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inside", inside).join(F.broadcast(ahead), "_part").withColumn(before, (F.col("_inside") + F.col("_ahead")).cast("bigint")).drop("_part", "_w", "_inside", "_ahead")


def average_rank(df: DataFrame, value: str, rank: str, descending: bool = False, salts: int = 8) -> DataFrame:
    """df with the average rank of value (ties share their mean rank); NULL and NaN have none.

    Ranks are found for distinct values with their counts. The join back is
    salted, as one value may belong to a third of all rows.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    counts = df.select(v.alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n"))
    ranked = running_total(counts, [F.col("_v").desc() if descending else F.col("_v")], F.col("_n"))
    ranks = ranked.select("_v", (F.col("before") + (F.col("_n") + 1) / 2).alias(rank), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = df.withColumn("_v", v).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(ranks, ["_v", "_salt"], "left").drop("_v", "_salt")
