"""One row per key, chosen by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_copy(df: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """_key and the columns of keep, of the row that comes first by (order, keep) with NULLs first.

    Partial minima are taken before the shuffle, so a key that owns a third of
    all rows costs one row per input split. Rows whose key is NULL are left out.
    The minimum of a row is aggregated by sorting; the key's 64-bit hash leads
    the grouping, so that rows sort by a number and not by texts that begin alike.
    """
    cols = list(dict.fromkeys([*order, *keep]))
    rows = df.select(key.alias("_key"), F.struct(*cols).alias("_row")).where("_key IS NOT NULL")
    return rows.groupBy(F.xxhash64("_key").alias("_h"), "_key").agg(F.min("_row").alias("_row")).select("_key", *[F.col(f"_row.{c}").alias(c) for c in keep])
