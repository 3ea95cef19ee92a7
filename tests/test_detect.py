import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.operators import detect, evaluate, score
from lodeflow.operators.forest import isolation_scores
from lodeflow.schemas import RESULT_COLUMNS, RULES

COLUMNS = "node bigint, address string, is_infra int, in_degree bigint, out_degree bigint, total_input_amount double, total_output_amount double, two_node_loop_count bigint, two_node_loop_amount double, two_node_loop_tx_count bigint, triangle_loop_count bigint, triangle_loop_amount double, triangle_loop_tx_count bigint, egonet_density double"
BASE = dict(in_degree=1, out_degree=1, total_input_amount=10.0, total_output_amount=20.0, two_node_loop_count=0, two_node_loop_amount=0.0, two_node_loop_tx_count=0, triangle_loop_count=0, triangle_loop_amount=0.0, triangle_loop_tx_count=0, egonet_density=0.5)
LIMITS = dict(in_degree=100.0, out_degree=50.0, two_node_loop_amount=1000.0, two_node_loop_tx_count=10.0, triangle_loop_amount=1000.0, triangle_loop_tx_count=10.0)


def frame(spark, changes):
    rows = [{"node": i, "address": f"0x{i}", "is_infra": 0} | BASE | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in COLUMNS.split(", ")) for r in rows], COLUMNS)


FIRES = {
    "H1": dict(in_degree=100, out_degree=3, total_input_amount=100.0, total_output_amount=95.0), "H2": dict(in_degree=100, out_degree=0), "H3": dict(in_degree=1, out_degree=50),
    "H4": dict(in_degree=100, out_degree=50, total_input_amount=100.0, total_output_amount=105.0), "H5": dict(two_node_loop_count=1, two_node_loop_amount=1000.0), "H6": dict(triangle_loop_count=1, triangle_loop_tx_count=10),
}


@pytest.mark.parametrize("rule", list(FIRES))
def test_each_rule_alone(spark, rule):
    limits = spark.createDataFrame([tuple(LIMITS.values())], ", ".join(f"{k} double" for k in LIMITS))
    r = detect.with_rules(frame(spark, [FIRES[rule]]), limits).first()
    assert [x for x in RULES if r[f"{x}_flag"]] == [rule] and r[f"{rule}_description"].startswith(rule) and all(r[f"{x}_description"] == "" for x in RULES if x != rule)


def test_missing_thresholds_fire_nothing(spark):
    df = frame(spark, [dict(two_node_loop_count=5), {}])
    q = detect.thresholds(df).first()
    assert q.two_node_loop_amount is None and q.in_degree == 1.0
    assert detect.rule_totals(detect.with_rules(df)).first().H5_flag == 0
    assert detect.thresholds(frame(spark, [dict(in_degree=x) for x in (1, 2, 3, 10)])).first().in_degree == pytest.approx(9.79)


def test_mahalanobis_trace_and_reference(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, [dict(in_degree=int(rng.integers(1, 99)), out_degree=int(rng.integers(0, 60)), total_input_amount=float(rng.lognormal(9)), total_output_amount=float(rng.lognormal(8)), egonet_density=float(rng.random())) for _ in range(80)])
    rows = score.statistics(df).orderBy("node").collect()
    z = np.array([[r[c] for c in detect.Z_SCORES if r[c] is not None] for r in rows], dtype=float)
    p = np.linalg.pinv(np.cov(z, rowvar=False), rcond=1e-10, hermitian=True)
    want = np.sqrt(np.einsum("ij,jk,ik->i", z - z.mean(0), p, z - z.mean(0)))
    got = np.array([r.mahalanobis_distance for r in rows])
    assert np.allclose(got, want, atol=1e-6) and (got**2).sum() == pytest.approx(5 * 79, rel=1e-6)
    assert {r.mahalanobis_distance for r in score.statistics(frame(spark, [{}, {}])).collect()} == {0.0}


def test_forest_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))] + [(400, 30.0, -30.0), (401, None, 0.0)]
    df = spark.createDataFrame(rows, "node bigint, a double, b double")
    run = lambda d: {r.node: r.iforest_score for r in isolation_scores(d, "node", ["a", "b"], trees=60, sample=128).collect()}
    one, two = run(df.repartition(1)), run(df.repartition(7))
    assert one == two and one[401] is None
    known = {k: v for k, v in one.items() if v is not None}
    assert max(known, key=known.get) == 400 and all(-0.5 < v < 0.5 for v in known.values())
    assert {r.iforest_score for r in isolation_scores(df, "node", []).collect()} == {0.0}


def test_result_table(spark):
    df = frame(spark, [dict(in_degree=i % 17, out_degree=i % 5, total_input_amount=float(i), egonet_density=i / 50) for i in range(50)])
    extra = {"chain_id": F.lit(1), "year": F.lit(2023), "month": F.lit(1), "in_transfer_count": F.lit(1), "out_transfer_count": F.lit(1), "balance_proxy": F.lit(0), "self_loop_count": F.lit(0), "egonet_node_count": F.lit(1), "egonet_edge_count": F.lit(0)}
    df = df.withColumns(extra).withColumn("is_infra", (F.col("node") == 7).cast("int"))
    rows = score.result_table(df, trees=20, sample=64).collect()
    assert rows[0].__fields__ == list(RESULT_COLUMNS) and len(rows) == 50
    infra = next(r for r in rows if r.node == 7)
    assert infra.H1_flag is None and infra.final_score_0_100 is None
    plain = [r for r in rows if r.node != 7]
    assert np.mean([r.iforest_stats_score_100 for r in plain]) == pytest.approx(50, abs=1e-3)
    assert max(plain, key=lambda r: r.final_score_0_100).final_score_top_percent == min(r.final_score_top_percent for r in plain)


def test_agreement_measures(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), float(i * i % 97), float(-i)) for i in range(200)], "address string, a double, b double, c double")
    assert evaluate.spearman(df, "a", "c").first().rho == pytest.approx(-1) and evaluate.spearman(df, "a", "c").first().p_value == 0.0
    assert evaluate.t_test_p(0.5, 20) == pytest.approx(0.024769, abs=1e-5) and evaluate.t_test_p(0.0, 10) == pytest.approx(1.0)
    assert evaluate.kappa(df, "a", "a").first().kappa == pytest.approx(1.0)
    same = evaluate.top_overlap(df, {"A": "a", "B": "a"}).collect()
    assert all(r.jaccard == 1.0 and r.overlap == 1.0 for r in same) and [r.k for r in same] == [max(1, round(200 * q)) for q in evaluate.SHARES]
    assert {r.n_all for r in evaluate.common_top(df, {"A": "a", "C": "c"}).collect()} == {0}
    summary, top = evaluate.diagnostics(df, "a", k=3)
    assert {r.summary: r.a for r in summary.collect()}["max"] == "199.0" and [r.a for r in top.collect()] == [199.0, 198.0, 197.0]
    assert math.isnan(evaluate.t_test_p(0.5, 2) or math.nan)


def test_forest_takes_every_row_up_to_the_reference_sample(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(1500, 2)))], "node bigint, a double, b double")
    run = lambda **k: {r.node: r.iforest_score for r in isolation_scores(df, "node", ["a", "b"], trees=8, **k).collect()}
    default = run()
    assert default == run(sample=100_000) and default != run(sample=1024)
    # Groups of a few trees give the same sums as all trees at once.
    grouped = run(group_nodes=4000)
    assert all(grouped[k] == pytest.approx(v, abs=1e-12) for k, v in default.items())
