import os

import duckdb
import pytest

import __spark_entry__ as entry

#: Small but telling; every query is compared by the driver.
NAMES = ["p3_trailing_totals", "p4_found", "p6_found", "p6_account_totals", "p7_found", "clean_transfers", "abstract_transfer", "edges", "vertices", "feature_table", "rules", "top_accounts", "quality_fk"]


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in (2, 4, 5, 6, 7)} <= set(q)


def test_entry(spark, data_dir):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data_dir, name):
    con = duckdb.connect()
    for f in os.listdir(data_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data_dir}/{f}'")
    df = entry.queries()[name](spark, data_dir)
    r = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([plain(row[at.index(c)]) for c in df.columns]) for row in r.fetchall())
    assert sorted(repr([plain(v) for v in row]) for row in df.collect()) == want
