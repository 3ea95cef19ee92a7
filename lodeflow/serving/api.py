"""The service's answers as functions of a result table, and an optional HTTP server."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from itertools import chain, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.schemas import RULES
from lodeflow.serving.sqlguard import Refused, run_select

#: Rows of an answer that are held at once; a longer answer is whole, too, but streamed.
HELD_ROWS = 10_000
UNITS = {"amounts": "ether (ETH)", "egonet_density": "0–1", "degree": "count", "scores": "0–100"}


def top(df: DataFrame, n: int) -> DataFrame:
    """ranking, address, final_score_0_100 of the n highest scores (NULLs last, ties by address)."""
    best = df.orderBy(F.col("final_score_0_100").desc_nulls_last(), "address").limit(n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("final_score_0_100").desc_nulls_last(), "address"))
    return best.select(rank.alias("ranking"), "address", F.round(F.col("final_score_0_100").cast("double"), 1).alias("final_score_0_100"))


def by_address(df: DataFrame, address: str) -> DataFrame:
    """The row of one address, in any case."""
    return df.where(F.lower("address") == F.lit(address.strip().lower())).limit(1)


def wei_to_eth(wei) -> str | None:
    """Wei as ether with six decimals."""
    return None if wei is None else f"{int(wei) / 1e18:.6f}"


def fired_rules(row: dict) -> list[dict]:
    return [{"rule": r, "description": row.get(f"{r}_description")} for r in RULES if row.get(f"{r}_flag") == 1]


def profile(df: DataFrame, chain: str, year: int, month: int, address: str) -> dict | list:
    """Everything known about one address; an empty list if it is unknown, no details for infrastructure."""
    found = by_address(df, address).collect()
    if not found:
        return []
    r = found[0].asDict()
    meta = {"chain": chain, "period": f"{year:04d}-{month:02d}", "address": r["address"], "units": UNITS}
    if r["is_infra"]:
        return {"meta": meta, "features": {"is_infra": True, "degree": None, "amounts": None, "motifs": None, "egonet": None}, "scores": None, "explanations": None}
    whole = lambda *names: {c: int(r[c]) for c in names}
    one = lambda c: None if r[c] is None else round(float(r[c]), 1)
    rules = fired_rules(r)
    return {
        "meta": meta,
        "features": {
            "is_infra": False,
            "degree": whole("in_degree", "out_degree", "in_transfer_count", "out_transfer_count"),
            "amounts": {f"{c}_eth": wei_to_eth(r[c]) for c in ("total_input_amount", "total_output_amount")},
            "motifs": whole("self_loop_count", "two_node_loop_count", "triangle_loop_count"),
            "egonet": {"egonet_density": one("egonet_density")},
        },
        "scores": {
            "rule_score_100": one("rule_score_100"),
            "mahalanobis_stats_100": one("mahalanobis_distance_stats_score_100"),
            "iforest_stats_100": one("iforest_stats_score_100"),
            "final_score_0_100": one("final_score_0_100"),
            "final_score_top_percent": r["final_score_top_percent_display"],
        },
        "explanations": {"rule_ids": [x["rule"] for x in rules], "rules": rules},
    }


class Streamed:
    """A long answer: its columns, and its records in order, once."""

    def __init__(self, columns: list[str], rows: Iterable[dict]) -> None:
        self.columns, self.rows = columns, rows

    def __iter__(self) -> Iterator[dict]:
        return iter(self.rows)

    def as_json(self) -> Iterator[str]:
        for i, r in enumerate(self):
            yield ("," if i else "[") + json.dumps(r, default=str)
        yield "]"

    def as_csv(self) -> Iterator[str]:
        yield as_csv([], self.columns)
        for r in self:
            yield as_csv([r], self.columns, header=False)


def records(df: DataFrame, digits: int = 6) -> list[dict] | Streamed:
    """A whole result as JSON-ready records: a list up to HELD_ROWS, beyond that one partition after the other."""
    plain = lambda v: round(v, digits) if isinstance(v, float) else int(v) if isinstance(v, Decimal) and v == v.to_integral_value() else float(v) if isinstance(v, Decimal) else v
    rows = ({k: plain(v) for k, v in r.asDict().items()} for r in df.toLocalIterator())
    first = list(islice(rows, HELD_ROWS + 1))
    return first if len(first) <= HELD_ROWS else Streamed(df.columns, chain(first, rows))


def as_csv(rows: Iterable[dict], columns: list[str], header: bool = True) -> str:
    out = io.StringIO()
    w = csv.DictWriter(out, columns, lineterminator="\n")
    if header:
        w.writeheader()
    w.writerows(rows)
    return out.getvalue()


class Service:
    """Status code and body for each request; `load(chain, year, month)` gives the month's result table or None."""

    def __init__(self, load: Callable[[str, int, int], DataFrame | None]) -> None:
        self.load = load

    def _month(self, chain, year, month) -> tuple[DataFrame | None, str | None]:
        try:
            y, m = int(year), int(month)
        except (TypeError, ValueError):
            return None, "missing or invalid chain/year/month"
        if not isinstance(chain, str) or not re.fullmatch(r"[a-z0-9_]+", chain) or not 1 <= m <= 12:
            return None, "missing or invalid chain/year/month"
        return self.load(chain, y, m), None

    def get_top(self, chain=None, year=None, month=None, n="100") -> tuple[int, object]:
        df, bad = self._month(chain, year, month)
        try:
            k = int(n)
        except (TypeError, ValueError):
            k = 0
        if bad or k < 1:
            return 400, {"error": bad or "invalid n"}
        if df is None:
            return 404, {"error": "no data for this month"}
        return 200, records(top(df, min(k, 2**31 - 1)), 1)

    def get_address(self, chain=None, year=None, month=None, addr="") -> tuple[int, object]:
        df, bad = self._month(chain, year, month)
        if bad:
            return 400, {"error": bad}
        if df is None:
            return 404, {"error": "no data for this month"}
        return 200, profile(df, chain, int(year), int(month), addr or "")

    def post_sql(self, body: dict, fmt: str = "json") -> tuple[int, object]:
        lacking = [k for k in ("chain", "year", "month", "sql") if (body or {}).get(k) in (None, "")]
        if lacking:
            return 400, {"error": "missing fields", "fields": lacking}
        df, bad = self._month(body["chain"], body["year"], body["month"])
        if bad or df is None:
            return 400, {"error": bad or "no data for this month"}
        try:
            out = run_select(df, body["sql"])
            rows = records(out)
        except Refused as e:
            return 400, {"error": str(e)}
        except Exception as e:  # the statement's own error is the caller's
            return 400, {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
        if isinstance(rows, Streamed):
            return 200, rows.as_csv() if fmt == "csv" else rows
        return 200, as_csv(rows, out.columns) if fmt == "csv" else rows


def make_server(service: Service, host: str = "127.0.0.1", port: int = 8000):
    """An HTTP server for /v1/top, /v1/address and /v1/sql."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qsl, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: object) -> None:
            parts = body.as_json() if isinstance(body, Streamed) else body if isinstance(body, Iterator) else None
            if parts is not None:
                # The end of the connection is the end of the answer.
                self.send_response(code)
                self.send_header("Content-Type", "application/json" if isinstance(body, Streamed) else "text/csv")
                self.end_headers()
                for p in parts:
                    self.wfile.write(p.encode())
                return
            data = (body if isinstance(body, str) else json.dumps(body, default=str)).encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/csv" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            call, known = {"/v1/top": (service.get_top, {"chain", "year", "month", "n"}), "/v1/address": (service.get_address, {"chain", "year", "month", "addr"})}.get(url.path, (None, set()))
            if call is None:
                return self._send(404, {"error": "not found"})
            return self._send(*call(**{k: v for k, v in parse_qsl(url.query) if k in known}))

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            if url.path != "/v1/sql":
                return self._send(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self._send(400, {"error": "body isn't JSON"})
            return self._send(*service.post_sql(body, dict(parse_qsl(url.query)).get("format", "json")))

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> None:
    """Answer requests until stopped."""
    make_server(service, host, port).serve_forever()
