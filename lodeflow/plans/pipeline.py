"""Queries of the transfer pipeline: cleaning, tables, graph, features, detectors, scores, evaluation, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.text import NULL_TOKENS
from lodeflow.operators import clean, detect, edgelist, evaluate, features, graph, quality, score
from lodeflow.operators.forest import isolation_scores
from lodeflow.operators.order import average_rank
from lodeflow.plans import network as N
from lodeflow.plans.p2_drift import SQL as P2_SQL
from lodeflow.plans.p2_drift import p2_blocks
from lodeflow.schemas import RAW_BLOCK_COLUMNS, RAW_TRANSFER_COLUMNS, RULE_TEXTS, SCHEMAS
from lodeflow.serving import api
from lodeflow.serving.sqlguard import run_select
from lodeflow.session import stored
from lodeflow.sources.tables import table

BLOCK_VALUES_SQL = P2_SQL["p2_block_values"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, text: tuple[str, ...] = ()):
    """Register a query and its SQL. text: amounts that the query gives as exact digits, as text."""
    if sql and text:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in text)}) FROM ({sql})"

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- cleaning and the abstract tables

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_RAW = ", ".join(f"CASE WHEN {c} NOT IN ({_TOKENS}) THEN {c} END AS {c}" for c in ("block_number", "transfer_index", "transaction_hash", "from_address", "to_address", "value_binary")) + f", coalesce(CASE WHEN chain_id NOT IN ({_TOKENS}) THEN chain_id END, '1') AS chain_id"
_NUM = "regexp_full_match(trim(block_number), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
_CHECKED = f"""ck AS (SELECT *, CASE WHEN block_number IS NULL OR transfer_index IS NULL OR transaction_hash IS NULL OR from_address IS NULL OR to_address IS NULL OR value_binary IS NULL THEN 'missing_value'
  WHEN NOT coalesce(length(trim(block_number)) <= 20 AND {_NUM} AND floor(try_cast(trim(block_number) AS DOUBLE)) BETWEEN 10000 AND 999999999, false) THEN 'block_number'
  WHEN NOT (starts_with(lower(trim(transaction_hash)), '0x') AND length(trim(transaction_hash)) = 66) THEN 'transaction_hash'
  WHEN NOT regexp_full_match(lower(trim(from_address)), '0x[0-9a-f]{{40}}') THEN 'from_address' WHEN NOT regexp_full_match(lower(trim(to_address)), '0x[0-9a-f]{{40}}') THEN 'to_address'
  WHEN NOT regexp_full_match(lower(trim(value_binary)), '0x[0-9a-f]{{64}}') THEN 'value_binary' WHEN NOT regexp_full_match(trim(transfer_index), '0*[0-9]{{1,18}}') THEN 'transfer_index'
  WHEN NOT (regexp_full_match(trim(chain_id), '0*[0-9]{{1,10}}') AND coalesce(TRY_CAST(trim(chain_id) AS BIGINT) <= 2147483647, false)) THEN 'chain_id' END AS reason FROM (SELECT delivery_id, {_RAW} FROM raw_native_transfer))"""
_CLEAN = f"""{_CHECKED}, cl AS (SELECT delivery_id, CAST(floor(CAST(trim(block_number) AS DOUBLE)) AS BIGINT) AS block_number, CAST(trim(transfer_index) AS BIGINT) AS transfer_index, lower(trim(transaction_hash)) AS transaction_hash, lower(trim(from_address)) AS from_address,
  lower(trim(to_address)) AS to_address, lower(trim(value_binary)) AS value_binary, CAST(trim(chain_id) AS INTEGER) AS chain_id FROM ck WHERE reason IS NULL)"""


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_transfers(table(spark, d, "raw_native_transfer"), "delivery_id")


@query(f"WITH {_CLEAN} SELECT * FROM cl")
def clean_transfers(spark, d):
    return _clean(spark, d)


@query(f"WITH {_CHECKED} SELECT coalesce(reason, 'kept') AS reject_reason, count(*) AS n_rows FROM ck GROUP BY 1")
def clean_rejects(spark, d):
    return clean.reject_counts(clean.checked_transfers(table(spark, d, "raw_native_transfer")))


#: Defects put into raw transfers by their delivery_id, so that every reason of cleaning is compared; the last keeps its row, but loses a fraction.
_DEFECTS = {
    1: ("block_number", "''"), 2: ("block_number", "'0x' || block_number"), 3: ("block_number", "block_number || 'd'"), 4: ("transaction_hash", "substr(transaction_hash, 1, 60)"), 5: ("from_address", "replace(from_address, '0x', '0y')"),
    6: ("to_address", "to_address || '0'"), 7: ("value_binary", "'0x5'"), 8: ("transfer_index", "'-1'"), 9: ("chain_id", "'main'"), 10: ("value_binary", "'NaN'"), 11: ("block_number", "'9999'"), 12: ("block_number", "trim(block_number) || '.75'"),
}


def _damaged(column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, (c, v) in _DEFECTS.items() if c == column)
    return f"CASE delivery_id % 40 {cases} ELSE {column} END AS {column}" if cases else column


_DAMAGED = ", ".join(("delivery_id", *map(_damaged, RAW_TRANSFER_COLUMNS)))


@query(f"WITH raw_native_transfer_damaged AS (SELECT {_DAMAGED} FROM raw_native_transfer), {_CHECKED.replace('FROM raw_native_transfer)', 'FROM raw_native_transfer_damaged)')} SELECT coalesce(reason, 'kept') AS reject_reason, count(*) AS n_rows FROM ck GROUP BY 1")
def clean_reject_reasons(spark, d):
    """Reasons of cleaning over transfers with defects put in: every reason occurs."""
    raw = table(spark, d, "raw_native_transfer", "delivery_id", *RAW_TRANSFER_COLUMNS).selectExpr("delivery_id", *map(_damaged, RAW_TRANSFER_COLUMNS))
    return clean.reject_counts(clean.checked_transfers(raw))


@query(f"""SELECT lower(trim(block_hash)) AS block_hash, CASE WHEN parent_hash NOT IN ({_TOKENS}) THEN parent_hash END AS parent_hash, CAST(block_number AS BIGINT) AS block_number, CAST("timestamp" AS BIGINT) AS "timestamp", CAST(coalesce(chain_id, '1') AS INTEGER) AS chain_id
  FROM ({BLOCK_VALUES_SQL}) WHERE CAST(block_number AS BIGINT) BETWEEN 10000 AND 999999999 AND regexp_full_match(lower(trim(block_hash)), '0x.{{64}}') AND "timestamp" IS NOT NULL""")
def clean_blocks(spark, d):
    """Clean blocks from files whose schemas drift."""
    return clean.clean_blocks(p2_blocks(spark, d).select(*[F.col(c).cast("string").alias(c) for c in RAW_BLOCK_COLUMNS]))


@query(f"WITH {N.NETWORK_SQL} SELECT DISTINCT concat('1_', CAST(block_number AS VARCHAR)) AS block_sid, block_number, CAST({N.FIRST_TIME} + {N.BLOCK_SECONDS} * (block_number - {N.FIRST_BLOCK}) AS BIGINT) AS \"timestamp\" FROM raw")
def abstract_block(spark, d):
    return clean.abstract_block(N.blocks(clean.clean_transfers(N.raw_transfers(spark, d))))


_BLOCK_OF = "concat(CAST(chain_id AS VARCHAR), '_', CAST(block_number AS VARCHAR))"


@query(f"WITH {_CLEAN} SELECT tx_sid, tx_hash, block_sid FROM (SELECT concat(CAST(chain_id AS VARCHAR), '_', transaction_hash) AS tx_sid, transaction_hash AS tx_hash, {_BLOCK_OF} AS block_sid, row_number() OVER (PARTITION BY chain_id, transaction_hash ORDER BY delivery_id, {_BLOCK_OF}) AS rn FROM cl) WHERE rn = 1")
def abstract_transaction(spark, d):
    return clean.abstract_transaction(_clean(spark, d), ("delivery_id",))




@query(f"""WITH {N.NETWORK_SQL} SELECT concat('1_', transaction_hash, '_', CAST(transfer_index AS VARCHAR)) AS transfer_sid, CAST(transfer_index AS BIGINT) AS transfer_index, CAST(amount AS VARCHAR) AS amount, 'transfer' AS category, concat('1_', transaction_hash) AS tx_sid,
  concat('1_', from_address) AS spender_address_sid, concat('1_', to_address) AS receiver_address_sid, '1_native' AS token_sid FROM tr""")
def abstract_transfer(spark, d):
    return clean.abstract_transfer(clean.clean_transfers(N.raw_transfers(spark, d)))


@query(f"WITH {_CLEAN} SELECT DISTINCT concat(CAST(chain_id AS VARCHAR), '_', a) AS account_sid, a AS address, 'unknown' AS type FROM (SELECT chain_id, from_address AS a FROM cl UNION ALL SELECT chain_id, to_address FROM cl)")
def abstract_account(spark, d):
    return clean.abstract_account(_clean(spark, d))


@query("SELECT '1_native' AS token_sid, '' AS token_address, 'ETH' AS token_symbol, 'native' AS token_standard, 18 AS token_decimals")
def abstract_token(spark, d):
    return clean.abstract_token(spark)


# ---------------------------------------------------------------- edge list and graph


def _ledger(spark, d):
    return table(spark, d, "abstract_token_transfer"), table(spark, d, "abstract_transaction", "tx_sid", "block_sid"), table(spark, d, "abstract_block", "block_sid", "timestamp")


_JOINED = "abstract_token_transfer t LEFT JOIN (SELECT tx_sid, block_sid, true AS there FROM abstract_transaction) x ON t.tx_sid = x.tx_sid LEFT JOIN (SELECT block_sid, \"timestamp\", true AS there FROM abstract_block) b ON x.block_sid = b.block_sid"


@query(f"SELECT t.transfer_sid, t.spender_address_sid AS from_address_sid, t.receiver_address_sid AS to_address_sid, t.amount, t.token_sid, t.tx_sid, b.\"timestamp\" FROM {_JOINED}")
def edgelist_ledger(spark, d):
    return edgelist.edgelist(*_ledger(spark, d))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (x.there IS NULL) AS without_tx, count(*) FILTER (x.there AND b.there IS NULL) AS without_block FROM {_JOINED}")
def edgelist_unmatched(spark, d):
    return edgelist.unmatched(*_ledger(spark, d))


_DIGITS = "regexp_replace(trim(amount, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '^0+([0-9])', '\\1')"


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (NOT coalesce(regexp_full_match(d, '[0-9]{{1,78}}'), false)) AS without_amount, count(*) FILTER (regexp_full_match(d, '[0-9]{{39,78}}')) AS beyond_38_digits FROM (SELECT {_DIGITS} AS d FROM abstract_token_transfer)""")
def edgelist_amounts(spark, d):
    return edgelist.dropped_amounts(table(spark, d, "abstract_token_transfer", "amount"))


@query(f"WITH {N.NETWORK_SQL} SELECT transfer_sid, f AS from_address_sid, t AS to_address_sid, CAST(amount AS HUGEINT) AS amount, '1_native' AS token_sid, tx_sid, CAST(ts AS BIGINT) AS \"timestamp\" FROM el", ("amount",))
def edgelist_filtered(spark, d):
    return N.filtered_edges(spark, d)


@query(f"WITH {N.NETWORK_SQL} SELECT f AS from_sid, t AS to_sid, amount, cnt AS \"count\", CAST(ts AS BIGINT) AS first_timestamp, '1_native' AS token_sid FROM ed", ("amount",))
def edges(spark, d):
    return graph.with_amounts(N.pairs(spark, d))


@query(f"WITH {N.NETWORK_SQL} SELECT sid, address, node, inf AS is_infra FROM vx")
def vertices(spark, d):
    return N.network(spark, d)[1]


@query(f"WITH {N.NETWORK_SQL}, {N.NODE_SQL} SELECT * FROM nf", ("total_input_amount", "total_output_amount", "balance_proxy"))
def node_features(spark, d):
    return features.node_features(N.network(spark, d)[2])


@query(f"""WITH {N.NETWORK_SQL} SELECT sid, count(*) AS total_degree, substr(sid, 3) AS address FROM (SELECT f AS sid FROM ed UNION ALL SELECT t FROM ed) JOIN vx USING (sid) WHERE inf = 0 GROUP BY sid ORDER BY total_degree DESC, sid LIMIT 100""")
def infra_candidates(spark, d):
    p = N.network(spark, d)[0]
    return graph.infra_candidates(p, N.whitelist(p))


def _inner(spark, d):
    return graph.without_infra(N.network(spark, d)[2])


@query(f"WITH {N.NETWORK_SQL}, {N.LOOPS_SQL} SELECT node, self_loop_count FROM lp WHERE self_loop_count > 0")
def self_loops(spark, d):
    return features.two_node_loops(_inner(spark, d)).where("self_loop_count > 0").select("node", "self_loop_count")


@query(f"WITH {N.NETWORK_SQL}, {N.LOOPS_SQL} SELECT * FROM lp", ("two_node_loop_amount",))
def two_node_loops(spark, d):
    return features.two_node_loops(_inner(spark, d))


@query(f"WITH {N.NETWORK_SQL}, {N.cycles_sql(N.ORDERED)} SELECT * FROM tl", ("triangle_loop_amount",))
def triangle_loops(spark, d):
    return features.triangle_loops(features.triangles(_inner(spark, d)))


@query(f"WITH {N.NETWORK_SQL}, {N.cycles_sql(N.ANY)} SELECT * FROM tl", ("triangle_loop_amount",))
def triangle_loops_all(spark, d):
    return features.triangle_loops(features.triangles(_inner(spark, d)), "all")


@query(f"WITH {N.NETWORK_SQL}, {N.EGO_SQL} SELECT * FROM eg")
def egonet(spark, d):
    e = _inner(spark, d)
    return features.egonets(e, features.triangles(e))


@query(f"WITH {N.FEATURES_SQL} SELECT * FROM ft", ("total_input_amount", "total_output_amount", "balance_proxy"))
def feature_table(spark, d):
    return N.feature_table(spark, d)


# ---------------------------------------------------------------- detectors and scores

_PLAIN = f"{N.FEATURES_SQL}, pl AS (SELECT * FROM ft WHERE is_infra = 0)"
_Q = lambda c: f"quantile_cont({c}::DOUBLE, 0.99)" if c in ("in_degree", "out_degree") else f"quantile_cont(CASE WHEN {c} > 0 THEN {c}::DOUBLE END, 0.99)"
_LIMITS = "th AS (SELECT " + ", ".join(f"{_Q(c)} AS q_{c}" for c in detect.THRESHOLDS) + " FROM pl)"
_EVEN = "coalesce(CASE WHEN total_input_amount > 0 THEN abs(total_input_amount::DOUBLE - total_output_amount::DOUBLE) / total_input_amount::DOUBLE END <= 0.05, false)"
_FLAGS = {
    "H1": f"in_degree >= q_in_degree AND out_degree <= 3 AND {_EVEN}", "H2": "in_degree >= q_in_degree AND out_degree = 0", "H3": "in_degree = 1 AND out_degree >= q_out_degree",
    "H4": f"in_degree >= q_in_degree AND out_degree >= q_out_degree AND {_EVEN}",
    "H5": "two_node_loop_count >= 1 AND (coalesce(two_node_loop_amount >= q_two_node_loop_amount, false) OR coalesce(two_node_loop_tx_count >= q_two_node_loop_tx_count, false))",
    "H6": "triangle_loop_count >= 1 AND (coalesce(triangle_loop_amount >= q_triangle_loop_amount, false) OR coalesce(triangle_loop_tx_count >= q_triangle_loop_tx_count, false))",
}
_RULED = f"{_PLAIN}, {_LIMITS}, rl AS (SELECT pl.*, " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN 1 ELSE 0 END AS {r}_flag" for r, c in _FLAGS.items()) + " FROM pl, th)"
_DESC = ", ".join(f"CASE WHEN {r}_flag = 1 THEN '{t}' ELSE '' END AS {r}_description" for r, t in RULE_TEXTS.items())


def _plain(spark, d) -> DataFrame:
    return N.feature_table(spark, d).where("is_infra = 0")


@query(f"WITH {_PLAIN} SELECT " + ", ".join(f"round({_Q(c)}, 3) AS {c}" for c in detect.THRESHOLDS) + " FROM pl")
def thresholds(spark, d):
    t = detect.thresholds(_plain(spark, d))
    return t.select(*[F.round(c, 3).alias(c) for c in t.columns])


def _ruled(spark, d) -> DataFrame:
    return detect.with_rules(stored(_plain(spark, d)))


@query(f"WITH {_RULED} SELECT node, {', '.join(f'{r}_flag' for r in RULE_TEXTS)}, {_DESC} FROM rl")
def rules(spark, d):
    return _ruled(spark, d).select("node", *[f"{r}_flag" for r in RULE_TEXTS], *[f"{r}_description" for r in RULE_TEXTS])


for _r in RULE_TEXTS:

    def _rule(spark, d, r=_r):
        return _ruled(spark, d).where(F.col(f"{r}_flag") == 1).select("node", "address", f"{r}_description")

    QUERIES[f"rules_{_r.lower()}"] = _rule
    SQL[f"rules_{_r.lower()}"] = f"WITH {_RULED} SELECT node, address, '{RULE_TEXTS[_r]}' AS {_r}_description FROM rl WHERE {_r}_flag = 1"


@query(f"WITH {_RULED} SELECT {', '.join(f'CAST(sum({r}_flag) AS BIGINT) AS {r}_flag' for r in RULE_TEXTS)} FROM rl")
def rule_totals(spark, d):
    return detect.rule_totals(_ruled(spark, d))


#: Features made of part numbers so that each of the six rules fires on some rows and on others does not.
_GRID = """SELECT p_partkey AS node, CASE WHEN p_partkey % 10 = 0 THEN 200 WHEN p_partkey % 10 = 1 THEN 1 ELSE p_partkey % 50 END AS in_degree, CASE WHEN p_partkey % 7 = 0 THEN 100 ELSE p_partkey % 5 END AS out_degree,
  1000.0 AS total_input_amount, CASE WHEN p_partkey % 4 = 0 THEN 980.0 WHEN p_partkey % 4 = 1 THEN 1049.0 ELSE 700.0 END AS total_output_amount,
  p_partkey % 6 AS two_node_loop_count, CAST(p_partkey % 97 AS DOUBLE) AS two_node_loop_amount, p_partkey % 83 AS two_node_loop_tx_count, p_partkey % 4 AS triangle_loop_count, CAST(p_partkey % 89 AS DOUBLE) AS triangle_loop_amount, p_partkey % 71 AS triangle_loop_tx_count FROM {part}"""


@query(f"WITH pl AS ({_GRID.format(part='part')}), {_LIMITS}, rl AS (SELECT pl.*, " + ", ".join(f"CASE WHEN coalesce({c}, false) THEN 1 ELSE 0 END AS {r}_flag" for r, c in _FLAGS.items()) + f" FROM pl, th) SELECT node, {', '.join(f'{r}_flag' for r in RULE_TEXTS)} FROM rl")
def rules_on_grid(spark, d):
    """All six rules on made-up features on which each of them fires."""
    made = spark.sql(_GRID, part=table(spark, d, "part", "p_partkey"))
    return detect.with_rules(made).select("node", *[f"{r}_flag" for r in RULE_TEXTS])


_LOGS = ", ".join(f"ln(1 + {c}::DOUBLE) AS {c}_log" for c in detect.LOGGED) + ", ln((in_degree + 1)::DOUBLE / (out_degree + 1)) AS log_degree_ratio, ln((total_input_amount::DOUBLE + 1) / (total_output_amount::DOUBLE + 1)) AS log_amount_ratio, egonet_density"
_LOGGED = f"{_PLAIN}, lg AS (SELECT node, {_LOGS} FROM pl)"
_ROUND = lambda c: F.round(c, 6)


@query(f"WITH {_LOGGED} SELECT node, {', '.join(f'round({c}, 6) AS {c}' for c in detect.TRANSFORMED)} FROM lg")
def log_features(spark, d):
    return detect.with_logs(_plain(spark, d)).select("node", *[_ROUND(F.col(c)).alias(c) for c in detect.TRANSFORMED])


@query(f"WITH {_LOGGED}, mo AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in detect.TRANSFORMED)} FROM lg) SELECT node, {', '.join(f'round(({c} - m_{c}) / CASE WHEN s_{c} > 1e-12 THEN s_{c} END, 5) AS {c}_z' for c in detect.TRANSFORMED)} FROM lg, mo")
def zscores(spark, d):
    logs = stored(detect.with_logs(_plain(spark, d)))
    return detect.with_z(logs, detect.moments(logs, detect.TRANSFORMED)).select("node", *[F.round(c, 5).alias(c) for c in detect.Z_SCORES])


_PAIRS = [(a, b) for i, a in enumerate(detect.TRANSFORMED) for b in detect.TRANSFORMED[i:]]


@query(f"WITH {_LOGGED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 5) AS covariance FROM lg" for a, b in _PAIRS))
def covariance(spark, d):
    m = detect.moments(detect.with_logs(_plain(spark, d)), detect.TRANSFORMED)
    at = {c: i for i, c in enumerate(m.columns)}
    return spark.createDataFrame([(a, b, float(m.covariance[at[a], at[b]])) for a, b in _PAIRS], "a string, b string, c double").select("a", "b", F.round("c", 5).alias("covariance"))


@query()
def mahalanobis(spark, d):
    return score.statistics(stored(_plain(spark, d))).select("node", "mahalanobis_distance")


@query()
def iforest(spark, d):
    s = stored(score.statistics(stored(_plain(spark, d))))
    return isolation_scores(s, "node", score.usable_scores(s))


_RULE_SCORED = f"{_RULED}, rs AS (SELECT node, address, in_degree, out_degree, greatest(H1_flag, H2_flag, H3_flag, H4_flag) + H5_flag + H6_flag AS rule_score_raw FROM rl), rr AS (SELECT *, CAST(round(rule_score_raw * 100 / 3.0::DOUBLE, 2) AS FLOAT) AS rule_score_100 FROM rs)"


@query(f"WITH {_RULE_SCORED} SELECT node, rule_score_raw, rule_score_100 FROM rr")
def rule_score(spark, d):
    return score.rule_score(_ruled(spark, d)).select("node", "rule_score_raw", "rule_score_100")


_RANK = lambda c, desc="": f"rank() OVER (ORDER BY {c} {desc}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"WITH {_PLAIN} SELECT node, CAST(({_RANK('in_degree')} - 0.5) / count(*) OVER () * 100 AS FLOAT) AS percentile FROM pl")
def hazen(spark, d):
    return score.hazen(stored(_plain(spark, d).select("node", "in_degree")), "in_degree", "percentile").select("node", "percentile")


_HAZEN = lambda c: f"CAST(({_RANK(c)} - 0.5) / count(*) OVER () * 100 AS FLOAT)"
_FINAL = f"""{_RULE_SCORED}, hz AS (SELECT *, {_HAZEN('in_degree')} AS d1, {_HAZEN('out_degree')} AS d2 FROM rr), fs AS (SELECT *, CAST((rule_score_100::DOUBLE + d1::DOUBLE + d2::DOUBLE) / 3 AS FLOAT) AS final_score_0_100 FROM hz),
fr AS (SELECT *, round_even(({_RANK('final_score_0_100', 'DESC')}) / count(*) OVER () * 100, 2) AS p FROM fs)"""


def _final(spark, d) -> DataFrame:
    """Scores without the forest: rules and the percentiles of both degrees."""
    s = stored(score.rule_score(_ruled(spark, d)).select("node", "address", "in_degree", "out_degree", "rule_score_100"))
    s = stored(score.hazen(score.hazen(s, "in_degree", "d1"), "out_degree", "d2"))
    return score.final_score(s, ("rule_score_100", "d1", "d2"))


@query(f"WITH {_FINAL} SELECT node, final_score_0_100, CAST(p AS FLOAT) AS final_score_top_percent, printf('%.2f%%', p) AS final_score_top_percent_display FROM fr")
def final_score_by_rank(spark, d):
    return _final(spark, d).select("node", "final_score_0_100", "final_score_top_percent", "final_score_top_percent_display")


@query(f"WITH {_FINAL} SELECT CAST(row_number() OVER (ORDER BY final_score_0_100 DESC, address) AS INTEGER) AS ranking, address, round(final_score_0_100::DOUBLE, 1) AS final_score_0_100 FROM fr ORDER BY ranking LIMIT 100")
def top_accounts(spark, d):
    return api.top(_final(spark, d), 100)


@query()
def result_table(spark, d):
    """The 44 columns for every account."""
    return score.result_table(N.feature_table(spark, d))


@query(f"WITH {_RULE_SCORED} SELECT node, address, rule_score_100 FROM rr WHERE address = (SELECT min(address) FROM rr)")
def address_profile(spark, d):
    s = stored(score.rule_score(_ruled(spark, d)).select("node", "address", "rule_score_100"))
    return api.by_address(s, s.agg(F.min("address")).first()[0])


@query(f"WITH {N.FEATURES_SQL} SELECT is_infra, count(*) AS n, max(in_degree) AS most FROM ft GROUP BY is_infra")
def sql_passthrough(spark, d):
    return run_select(N.feature_table(spark, d), "SELECT is_infra, count(*) AS n, max(in_degree) AS most FROM t GROUP BY is_infra")


# ---------------------------------------------------------------- evaluation

_SCORES = {"Rule": "rule_score_100", "In": "d1", "Out": "d2"}
_TOPS = f"{_FINAL}, tp AS (SELECT address, " + ", ".join(f"row_number() OVER (ORDER BY {c} DESC, address) AS r_{n}" for n, c in _SCORES.items()) + ", count(*) OVER () AS n FROM fr)"
_KS = " UNION ALL ".join(f"SELECT {q * 100!r}::DOUBLE AS q_percent, CAST(greatest(1, round_even(n * {q!r}::DOUBLE, 0)) AS INTEGER) AS k, * EXCLUDE (n) FROM tp" for q in evaluate.SHARES)


def _overlap_sql() -> str:
    part = "SELECT q_percent, k, '{a} vs {b}' AS pair, count(*) FILTER (r_{a} <= k AND r_{b} <= k) AS n_both, count(*) FILTER (r_{a} <= k OR r_{b} <= k) AS n_any, (count(*) FILTER (r_{a} <= k AND r_{b} <= k))::DOUBLE / count(*) FILTER (r_{a} <= k OR r_{b} <= k) AS jaccard, (count(*) FILTER (r_{a} <= k AND r_{b} <= k))::DOUBLE / k AS overlap FROM ks GROUP BY q_percent, k"
    return f"WITH {_TOPS}, ks AS ({_KS}) " + " UNION ALL ".join(part.format(a=a, b=b) for a, b in (("Rule", "In"), ("Rule", "Out"), ("In", "Out")))


@query(_overlap_sql())
def topq_overlap(spark, d):
    return evaluate.top_overlap(stored(_final(spark, d)), _SCORES)


@query(f"WITH {_TOPS}, ks AS ({_KS}) SELECT q_percent, k, count(*) FILTER (r_Rule <= k AND r_In <= k AND r_Out <= k) AS n_all FROM ks GROUP BY q_percent, k")
def triple_overlap(spark, d):
    return evaluate.common_top(stored(_final(spark, d)), _SCORES)


@query(f"WITH {_PLAIN}, rk AS (SELECT {_RANK('in_degree')} AS a, {_RANK('out_degree')} AS b FROM pl) SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM rk")
def spearman(spark, d):
    return evaluate.spearman(stored(_plain(spark, d).select("in_degree", "out_degree")), "in_degree", "out_degree").select(F.round("rho", 9).alias("rho"), "n")


@query(f"""WITH {_PLAIN}, qq AS (SELECT quantile_cont(in_degree::DOUBLE, 0.99) AS qa, quantile_cont(out_degree::DOUBLE, 0.99) AS qb FROM pl),
fl AS (SELECT in_degree >= qa AS x, out_degree >= qb AS y FROM pl, qq), cc AS (SELECT count(*) FILTER (x AND y) AS n11, count(*) FILTER (x AND NOT y) AS n10, count(*) FILTER (NOT x AND y) AS n01, count(*) FILTER (NOT x AND NOT y) AS n00, count(*)::DOUBLE AS n FROM fl)
SELECT n11, n10, n01, n00, round(((n11 + n00) / n - ((n11 + n10) / n * (n11 + n01) / n + (n01 + n00) / n * (n10 + n00) / n)) / (1 - ((n11 + n10) / n * (n11 + n01) / n + (n01 + n00) / n * (n10 + n00) / n)), 9) AS kappa FROM cc""")
def kappa(spark, d):
    return evaluate.kappa(stored(_plain(spark, d).select("in_degree", "out_degree")), "in_degree", "out_degree").withColumn("kappa", F.round("kappa", 9))


@query(f"WITH {_PLAIN} SELECT node, {_RANK('out_degree')} AS rank_avg FROM pl")
def average_ranks(spark, d):
    return average_rank(_plain(spark, d).select("node", "out_degree"), "out_degree", "rank_avg").select("node", "rank_avg")


# ---------------------------------------------------------------- checks of the ledger tables

_KEYS = {"abstract_token_transfer": "transfer_sid", "abstract_transaction": "tx_sid", "abstract_block": "block_sid", "abstract_account": "account_sid"}
_FKS = (("abstract_token_transfer", "spender_address_sid", "abstract_account", "account_sid"), ("abstract_token_transfer", "receiver_address_sid", "abstract_account", "account_sid"), ("abstract_token_transfer", "tx_sid", "abstract_transaction", "tx_sid"), ("abstract_transaction", "block_sid", "abstract_block", "block_sid"))
_REQUIRED = {"abstract_token_transfer": ["transfer_sid", "amount", "tx_sid", "spender_address_sid", "receiver_address_sid", "token_sid"], "abstract_transaction": ["tx_sid", "block_sid"], "abstract_block": ["block_sid", "timestamp"], "abstract_account": ["account_sid", "type"]}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(" UNION ALL ".join(f"SELECT 'primary_key' AS check_name, '{t}' AS table_name, '{k}' AS column_name, count(*) AS n_rows, count(*) - count(DISTINCT {k}) AS n_bad FROM {t}" for t, k in _KEYS.items()))
def quality_pk(spark, d):
    return _union([quality.key_check(table(spark, d, t, k), t, k) for t, k in _KEYS.items()])


@query(" UNION ALL ".join(f"SELECT 'not_null' AS check_name, '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_bad FROM {t}" for t, cs in _REQUIRED.items() for c in cs).replace("count(timestamp)", 'count("timestamp")'))
def quality_nulls(spark, d):
    return _union([quality.null_checks(table(spark, d, t), t, cs) for t, cs in _REQUIRED.items()])


@query(" UNION ALL ".join(f"SELECT 'foreign_key' AS check_name, '{t}' AS table_name, '{k}' AS column_name, count(*) AS n_rows, count(*) FILTER ({k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS n_bad FROM {t}" for t, k, p, pk in _FKS))
def quality_fk(spark, d):
    return _union([quality.reference_check(table(spark, d, t, k), t, k, table(spark, d, p, pk).distinct(), pk) for t, k, p, pk in _FKS])


@query(f"""SELECT 'range' AS check_name, 'abstract_block' AS table_name, 'timestamp' AS column_name, count(*) AS n_rows, count(*) FILTER (NOT coalesce("timestamp" BETWEEN {quality.LOWEST_TIME} AND {quality.HIGHEST_TIME}, false)) AS n_bad FROM abstract_block
UNION ALL SELECT 'domain', 'abstract_token_transfer', 'token_sid', count(*), count(*) FILTER (NOT coalesce(token_sid = '1_native', false)) FROM abstract_token_transfer
UNION ALL SELECT 'amount', 'abstract_token_transfer', 'amount', count(*), count(*) FILTER (NOT coalesce(regexp_full_match(amount, '[0-9]{{1,78}}') AND amount <> '0', false)) FROM abstract_token_transfer""")
def quality_ranges(spark, d):
    t = table(spark, d, "abstract_token_transfer")
    return _union([quality.range_check(table(spark, d, "abstract_block"), "abstract_block", "timestamp"), quality.domain_check(t, "abstract_token_transfer", "token_sid", ["1_native"]), quality.amount_check(t, "abstract_token_transfer", "amount")])


_CAST = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "TIMESTAMP": "timestamp"}
_TYPES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c.split()[0]}' AS column_name, '{c.split()[1]}' AS expected, CASE any_value(typeof(\"{c.split()[0]}\")) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _CAST.items())} END AS actual FROM {t}" for t, s in SCHEMAS.items() for c in s.split(", "))


@query(f"SELECT *, expected = actual AS ok FROM ({_TYPES})")
def quality_types(spark, d):
    return _union([quality.type_check(table(spark, d, t), t, s) for t, s in SCHEMAS.items()])


_RAW_TEXT = ("batch_id", "block_number", "transfer_index", "transaction_hash", "from_address", "to_address", "value_binary", "chain_id")
_PLAIN_NUMBER = "regexp_full_match(trim({c}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_values, count({c}) = count(*) FILTER ({_PLAIN_NUMBER.format(c=c)}) AS all_numeric FROM raw_native_transfer" for c in _RAW_TEXT))
def numeric_text_columns(spark, d):
    return quality.numeric_text(table(spark, d, "raw_native_transfer"))


