"""Parquet tables of one data directory, and the layout chain/year/month of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table; only the columns named, if any are."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as there are cores, by a hash of the keys, where its files give fewer.

    For scans before heavy work per row: a small table in one file would keep
    one core busy. A table of many files, as any large one, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
