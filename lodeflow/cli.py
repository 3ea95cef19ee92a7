"""The monthly batch: python -m lodeflow.cli --chain ethereum --year 2023 --month 1 --stage all --root DIR.

Stages read and write parquet below root/<stage>/<chain>/<year>/<month>; raw CSV lies
in root/raw/<chain>/blocks and root/raw/<chain>/native_transfers under year and month.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.operators import clean, edgelist, features, graph, score
from lodeflow.schemas import RAW_BLOCK_COLUMNS, RAW_TRANSFER_COLUMNS
from lodeflow.session import build_session, ship
from lodeflow.sources.layout import month_path, read_csv_text, read_table, write_csv, write_table

#: The order of the raw rows.
ORDER = ("source_file", "source_block", "source_row")
STAGES = ("clean", "abstract", "graph", "features", "result")


def run_clean(spark: SparkSession, root: str, at: tuple) -> None:
    raw = lambda kind, columns: read_csv_text(spark, month_path(root, f"raw/{at[0]}/{kind}", None, *at[1:]), columns)
    blocks = raw("blocks", RAW_BLOCK_COLUMNS)
    write_table(clean.clean_blocks(blocks), month_path(root, "clean/blocks", *at))
    transfers = raw("native_transfers", RAW_TRANSFER_COLUMNS)
    write_table(clean.clean_transfers(transfers, *ORDER), month_path(root, "clean/transfers", *at))
    report = clean.drop_report(clean.checked_blocks(blocks), "blocks").unionByName(clean.drop_report(clean.checked_transfers(transfers), "native_transfers"))
    report.orderBy("stage", "what").show(100, truncate=False)


def run_abstract(spark: SparkSession, root: str, at: tuple) -> None:
    blocks, t = read_table(spark, month_path(root, "clean/blocks", *at)), read_table(spark, month_path(root, "clean/transfers", *at))
    order = ORDER
    made = {"block": clean.abstract_block(blocks), "transaction": clean.abstract_transaction(t, order), "token_transfer": clean.abstract_transfer(t, order), "account": clean.abstract_account(t), "token": clean.abstract_token(spark)}
    for name, df in made.items():
        write_table(df, month_path(root, f"abstract/{name}", *at))


def run_graph(spark: SparkSession, root: str, at: tuple) -> None:
    tables = [read_table(spark, month_path(root, f"abstract/{n}", *at)) for n in ("token_transfer", "transaction", "block")]
    edgelist.unmatched(*tables).show()
    edgelist.dropped_amounts(tables[0]).show()
    pairs_at = month_path(root, "graph/pairs", *at)
    write_table(graph.aggregate_edges(edgelist.filter_edges(edgelist.edgelist(*tables))), pairs_at)
    write_table(graph.number_vertices(read_table(spark, pairs_at)), month_path(root, "graph/vertices", *at))


def run_features(spark: SparkSession, root: str, at: tuple, whitelist: DataFrame) -> None:
    pairs, vertices = (read_table(spark, month_path(root, f"graph/{n}", *at)) for n in ("pairs", "vertices"))
    flagged_at, edges_at = month_path(root, "graph/flagged", *at), month_path(root, "graph/edges", *at)
    write_table(graph.flag_infra(vertices, whitelist), flagged_at)
    flagged = read_table(spark, flagged_at)
    write_table(graph.numbered_edges(pairs, flagged), edges_at)
    write_table(features.assemble(flagged, read_table(spark, edges_at), at[1], at[2]), month_path(root, "features", *at))


def run_result(spark: SparkSession, root: str, at: tuple, csv: bool) -> None:
    result = month_path(root, "result", *at)
    write_table(score.result_table(read_table(spark, month_path(root, "features", *at))), result)
    if csv:
        write_csv(read_table(spark, result).orderBy("node"), result + "_csv")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--chain", default="ethereum")
    p.add_argument("--year", type=int, required=True)
    p.add_argument("--month", type=int, required=True)
    p.add_argument("--stage", choices=(*STAGES, "all", "serve"), default="all")
    p.add_argument("--root", required=True)
    p.add_argument("--whitelist", help="CSV with a column address")
    p.add_argument("--csv", action="store_true", help="write the result as CSV too")
    p.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    spark, at = build_session("lodeflow"), (a.chain, a.year, a.month)
    ship(spark)
    if a.stage == "serve":
        from lodeflow.serving.api import Service, serve
        from lodeflow.sources.layout import month_or_none

        return serve(Service(lambda chain, y, m: month_or_none(spark, month_path(a.root, "result", chain, y, m))), port=a.port)
    listed = spark.read.option("header", True).csv(a.whitelist).select("address") if a.whitelist else spark.createDataFrame([], "address string")
    for stage in STAGES if a.stage == "all" else (a.stage,):
        {
            "clean": lambda: run_clean(spark, a.root, at), "abstract": lambda: run_abstract(spark, a.root, at), "graph": lambda: run_graph(spark, a.root, at),
            "features": lambda: run_features(spark, a.root, at, listed.select(F.col("address"))), "result": lambda: run_result(spark, a.root, at, a.csv),
        }[stage]()


if __name__ == "__main__":
    main()
