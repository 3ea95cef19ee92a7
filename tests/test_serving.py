import json
import threading
from decimal import Decimal
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest
from pyspark.sql import functions as F

from lodeflow.serving.api import Service, make_server, wei_to_eth
from lodeflow.serving.sqlguard import Refused, check, run_select


@pytest.fixture(scope="module")
def month(spark):
    rows = [("0xAb", 0, 90.04, 1, Decimal(10**18), 1), ("0xcd", 0, 90.04, 0, Decimal(5), 2), ("0xef", 1, None, None, None, 3)]
    df = spark.createDataFrame(rows, "address string, is_infra int, final_score_0_100 double, H2_flag int, total_input_amount decimal(38,0), in_degree bigint")
    more = {c: F.lit(1) for c in ("out_degree", "in_transfer_count", "out_transfer_count", "self_loop_count", "two_node_loop_count", "triangle_loop_count", "total_output_amount")}
    more |= {c: F.lit(12.34) for c in ("egonet_density", "rule_score_100", "mahalanobis_distance_stats_score_100", "iforest_stats_score_100")}
    more |= {"final_score_top_percent_display": F.lit("1.00%"), "H2_description": F.lit("H2: text")} | {f"H{i}_flag": F.lit(0) for i in (1, 3, 4, 5, 6)}
    return df.withColumns(more)


@pytest.fixture(scope="module")
def service(month):
    return Service(lambda chain, y, m: month if (y, m) == (2023, 1) else None)


def test_top(service):
    assert service.get_top("ethereum", "2023", "1", "2") == (200, [{"ranking": 1, "address": "0xAb", "final_score_0_100": 90.0}, {"ranking": 2, "address": "0xcd", "final_score_0_100": 90.0}])
    assert service.get_top("ethereum", "2023", "x")[0] == 400 and service.get_top("ethereum", "2023", "1", "0")[0] == 400 and service.get_top("../x", "2023", "1")[0] == 400 and service.get_top(None, "2023", "1")[0] == 400
    assert service.get_top("ethereum", "2022", "1")[0] == 404


def test_address(service):
    code, r = service.get_address("ethereum", "2023", "1", " 0XAB ")
    assert code == 200 and r["explanations"] == {"rule_ids": ["H2"], "rules": [{"rule": "H2", "description": "H2: text"}]} and r["features"]["amounts"]["total_input_amount_eth"] == "1.000000" and r["meta"]["period"] == "2023-01"
    assert service.get_address("ethereum", "2023", "1", "0xef")[1]["scores"] is None and service.get_address("ethereum", "2023", "1", "nobody") == (200, [])
    assert wei_to_eth(None) is None and wei_to_eth(1234567 * 10**12) == "1.234567"


def test_sql(service):
    body = {"chain": "ethereum", "year": 2023, "month": 1, "sql": "SELECT address, in_degree FROM t WHERE is_infra = 0 ORDER BY address"}
    assert service.post_sql(body) == (200, [{"address": "0xAb", "in_degree": 1}, {"address": "0xcd", "in_degree": 2}])
    assert service.post_sql(body, "csv") == (200, "address,in_degree\n0xAb,1\n0xcd,2\n")
    assert service.post_sql(body | {"sql": ""}) == (400, {"error": "missing fields", "fields": ["sql"]})
    assert service.post_sql(body | {"sql": "SELECT nothing FROM t"})[0] == 400 and service.post_sql(body | {"month": 2})[0] == 400


@pytest.mark.parametrize("sql", [
    "WITH a AS (SELECT 1) SELECT * FROM a", "DROP TABLE t", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/passwd`", "SELECT * FROM other", "SELECT * FROM default.t", "SELECT reflect('java.lang.System', 'exit', '1')",
    "SELECT (SELECT max(x) FROM secret) FROM t", "SELECT * FROM t WHERE EXISTS (SELECT 1 FROM secret)", "SELECT * FROM t WHERE address IN (SELECT address FROM secret)", "SELECT * FROM range(10)", "SELECT 'drop' FROM t", "SELECT * FROM t JOIN u ON true", "", "SELECT * FROM t WHERE (",
])
def test_refused(spark, sql):
    with pytest.raises(Refused):
        check(spark, sql)


def test_allowed(spark, month):
    for sql in ("SELECT count(*) AS n FROM t", "SELECT * FROM (SELECT max(in_degree) AS m FROM t) x", "SELECT a.address FROM t a JOIN t b ON a.address = b.address", "SELECT address FROM t WHERE in_degree > (SELECT avg(in_degree) FROM t)"):
        run_select(month, sql).collect()
    assert not [x for x in spark.catalog.listTables() if x.name == "t"]


def test_http(service):
    server = make_server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urlopen(f"{root}/v1/top?chain=ethereum&year=2023&month=1&n=1"))[0]["address"] == "0xAb"
        body = json.dumps({"chain": "ethereum", "year": 2023, "month": 1, "sql": "SELECT count(*) AS n FROM t"}).encode()
        assert urlopen(Request(f"{root}/v1/sql?format=csv", body)).read() == b"n\n3\n"
        for path, data, code in (("/v1/top?year=2023", None, 400), ("/nothing", None, 404), ("/v1/sql", b"{", 400), ("/v1/top?chain=a&year=1&month=1", None, 404)):
            with pytest.raises(HTTPError) as e:
                urlopen(Request(root + path, data))
            assert e.value.code == code
    finally:
        server.shutdown()


def test_long_answers_are_streamed_whole(service, monkeypatch):
    body = {"chain": "ethereum", "year": 2023, "month": 1, "sql": "SELECT address FROM t ORDER BY address"}
    monkeypatch.setattr("lodeflow.serving.api.HELD_ROWS", 2)
    want = [{"address": x} for x in ("0xAb", "0xcd", "0xef")]
    assert list(service.post_sql(body)[1]) == want and "".join(service.post_sql(body, "csv")[1]) == "address\n0xAb\n0xcd\n0xef\n"
    assert len(list(service.get_top("ethereum", "2023", "1", "9" * 12)[1])) == 3
    server = make_server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}/v1/sql"
        assert json.load(urlopen(Request(root, json.dumps(body).encode()))) == want
        assert urlopen(Request(root + "?format=csv", json.dumps(body).encode())).read() == b"address\n0xAb\n0xcd\n0xef\n"
    finally:
        server.shutdown()
