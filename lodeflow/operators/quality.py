"""Checks of the abstract tables: keys, NULLs, types, references, ranges and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.text import number_or_null

LOWEST_TIME, HIGHEST_TIME = 1_400_000_000, 2_500_000_000


def _row(df: DataFrame, check: str, table: str, column: str, bad) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("n_bad")).select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "n_rows", "n_bad")


def key_check(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows whose key is NULL or belongs to another row too (all but one of each key)."""
    g = df.groupBy(key).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).cast("bigint").alias("n_bad")).select(F.lit("primary_key").alias("check_name"), F.lit(table).alias("table_name"), F.lit(key).alias("column_name"), "n_rows", "n_bad")


def null_checks(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_bad")) for c in columns])).alias("p")
    return counts.select("n_rows", pairs).select(F.lit("not_null").alias("check_name"), F.lit(table).alias("table_name"), "p.column_name", "n_rows", "p.n_bad")


def reference_check(child: DataFrame, table: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key no parent has."""
    keys = child.groupBy(key).agg(F.count("*").alias("n"))
    bad = keys.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad"))
    rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    both = rows.select("n_rows", F.lit(0).cast("bigint").alias("n_bad")).unionByName(bad.select(F.lit(0).cast("bigint").alias("n_rows"), "n_bad"))
    return both.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad")).select(F.lit("foreign_key").alias("check_name"), F.lit(table).alias("table_name"), F.lit(key).alias("column_name"), "n_rows", "n_bad")


def range_check(df: DataFrame, table: str, column: str, low: int = LOWEST_TIME, high: int = HIGHEST_TIME) -> DataFrame:
    return _row(df, "range", table, column, F.count_if(~F.coalesce(F.col(column).between(low, high), F.lit(False))))


def domain_check(df: DataFrame, table: str, column: str, allowed: list[str]) -> DataFrame:
    return _row(df, "domain", table, column, F.count_if(~F.coalesce(F.col(column).isin(allowed), F.lit(False))))


def amount_check(df: DataFrame, table: str, column: str) -> DataFrame:
    """Amounts that aren't digits, are zero, or have more than 78 digits."""
    return _row(df, "amount", table, column, F.count_if(~F.coalesce(F.col(column).rlike("^[0-9]{1,78}$") & (F.col(column) != "0"), F.lit(False))))


def type_check(df: DataFrame, table: str, expected: str) -> DataFrame:
    """check_name, table_name, column_name, expected, actual, ok: declared against found types."""
    found = dict(df.dtypes)
    rows = [(table, c, t, found.get(c, "missing"), found.get(c) == t) for c, t in (x.split() for x in expected.split(", "))]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, expected string, actual string, ok boolean")


def numeric_text(df: DataFrame) -> DataFrame:
    """column_name, n_values, all_numeric: text columns whose every value is a plain number (12d and 7f are none)."""
    text = [c for c, t in df.dtypes if t == "string"]
    counts = df.agg(*[F.struct(F.count(c).alias("n"), F.count(number_or_null(c)).alias("k")).alias(c) for c in text])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c)["n"].alias("n_values"), (F.col(c)["n"] == F.col(c)["k"]).alias("all_numeric")) for c in text])).alias("r")).select("r.*")
