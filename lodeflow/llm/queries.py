"""Queries of this package and their SQL."""

from __future__ import annotations

from lodeflow.llm import p1_distinct, p8_packing, p9_mixing, p10_pii

_ALL = (p1_distinct, p8_packing, p9_mixing, p10_pii)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
