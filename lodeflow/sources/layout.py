"""The tree root/<stage>/<chain>/<year>/<month>, CSV read as text, parquet and CSV written."""

from __future__ import annotations

import csv
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def month_path(root: str, stage: str, chain: str | None, year: int, month: int) -> str:
    return "/".join([root.rstrip("/"), stage, *([chain] if chain else []), f"{year:04d}", f"{month:02d}"])


def _headers(spark: SparkSession, folder: str) -> dict[str, tuple[str, ...]]:
    """Path of each *.csv of a folder and the names in its first line."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for f in fs.listStatus(root):
        if f.isFile() and f.getPath().getName().endswith(".csv"):
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(f.getPath()), "UTF-8"))
            first = (lines.readLine() or "").lstrip("\ufeff")
            lines.close()
            out[f.getPath().toString()] = tuple(next(csv.reader([first]), []))
    return out


def read_csv_text(spark: SparkSession, folder: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns of all *.csv of a folder as text, with source_file, source_block and source_row.

    Columns are found by each file's own header, in any order and among others;
    a file without one of them is an error, as is a folder without files. A
    byte-order mark is removed. Files are split among tasks; only those with
    line breaks inside quotes (found by a scan for lines with an odd number of
    quotes) are read in one piece. source_block and source_row (bigint) rise
    together within a file.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, names in sorted(_headers(spark, folder).items()):
        lacking = [c for c in columns if c not in names]
        if lacking:
            raise ValueError(f"{path} has no column {', '.join(lacking)}")
        by_header.setdefault(names, []).append(path)
    if not by_header:
        raise FileNotFoundError(f"no CSV files in {folder}")
    paths = [p for group in by_header.values() for p in group]
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    broken = {r.f for r in spark.read.text(paths).where(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    plain = lambda p: unquote(urlsplit(p).path)
    whole = {plain(p) for p in broken}
    out = None
    for names, group in by_header.items():
        at = {c: f"c{names.index(c)}" for c in columns}
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        for multi in (False, True):
            chosen = [p for p in group if (plain(p) in whole) == multi]
            if chosen:
                df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multi).option("escape", '"').csv(chosen)
                meta = F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block")
                df = df.select(*[F.col(i).alias(c) for c, i in at.items()], *meta, F.monotonically_increasing_id().alias("source_row"))
                out = df if out is None else out.unionByName(df)
    return out


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def month_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
