import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeflow.functions import uint256
from lodeflow.operators import edgelist, features, graph
from lodeflow.operators.order import average_rank, running_total
from lodeflow.plans import network as N


def pairs(spark, rows):
    """rows: (from, to, amount, count)."""
    d = spark.createDataFrame([(f, t, str(a), c, 1, "1_native") for f, t, a, c in rows], "from_sid string, to_sid string, amount string, count bigint, first_timestamp bigint, token_sid string")
    return d.select("from_sid", "to_sid", *uint256.split(F.col("amount")), "count", "first_timestamp", "token_sid")


def build(spark, rows, infra=()):
    p = pairs(spark, rows)
    v = graph.flag_infra(graph.number_vertices(p), spark.createDataFrame([(f" {x.upper()} ",) for x in infra] or [(None,)], "address string"))
    e = graph.numbered_edges(p, v)
    return v, e, {r.sid: r.node for r in v.collect()}


def test_numbers_follow_first_appearance(spark):
    rng = random.Random(5)
    rows = list({(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(200)})
    _, _, ids = build(spark, [(f, t, 1, 1) for f, t in rows])
    order = list(dict.fromkeys(x for e in sorted(rows) for x in e))
    assert ids == {x: i for i, x in enumerate(order)}


def test_hand_made_motifs(spark):
    # a mutual pair, a self-loop, a rising cycle, one the other way round, an infrastructure neighbour
    rows = [("a", "b", 5, 2), ("b", "a", 7, 1), ("c", "c", 11, 3), ("d", "e", 1, 1), ("e", "f", 2, 1), ("f", "d", 4, 1), ("g", "i", 1, 1), ("i", "h", 1, 1), ("h", "g", 1, 1), ("a", "x", 9, 1), ("x", "a", 9, 1)]
    v, e, ids = build(spark, rows, ["x"])
    t = {r.address: r for r in features.assemble(v, e, 2023, 1).collect()}
    assert (t["a"].two_node_loop_count, t["a"].two_node_loop_amount, t["a"].two_node_loop_tx_count) == (1, 12.0, 3)
    assert (t["c"].self_loop_count, t["c"].two_node_loop_count, t["c"].two_node_loop_amount, t["c"].two_node_loop_tx_count) == (1, 1, 22.0, 6)
    assert (t["c"].in_degree, t["c"].out_degree, t["c"].egonet_node_count, t["c"].egonet_density) == (1, 1, 1, 0.0)
    assert [t[x].triangle_loop_count for x in "def"] == [1, 1, 1] and t["d"].triangle_loop_amount == 7.0
    rising = ids["g"] < ids["i"] < ids["h"]
    assert [t[x].triangle_loop_count for x in "ghi"] == [int(rising)] * 3
    assert t["a"].in_degree == 2 and t["a"].egonet_node_count == 2 and t["a"].egonet_density == 1.0
    assert t["x"].in_degree is None and t["x"].egonet_density is None and t["x"].is_infra == 1
    both = {r.node: r.triangle_loop_count for r in features.triangle_loops(features.triangles(graph.without_infra(e)), "all").collect()}
    assert both == {ids[x]: 1 for x in "defghi"}


def test_random_graph_against_brute_force(spark):
    rng = random.Random(2)
    edges = {}
    for _ in range(260):
        a, b = rng.choice("hhh" + "abcdefgijklmnopq"), rng.choice("abcdefghijklmnopq")
        edges[a, b] = (rng.randrange(1, 100), rng.randrange(1, 4))
    v, e, ids = build(spark, [(a, b, x, n) for (a, b), (x, n) in edges.items()], ["m"])
    inner = {(ids[a], ids[b]): xn for (a, b), xn in edges.items() if "m" not in (a, b)}
    tri, near = defaultdict(list), defaultdict(set)
    for u, w in inner:
        near[u].add(w)
        near[w].add(u)
        for x, y in inner:
            if x == w and u < w < y and (y, u) in inner:
                s = tuple(map(sum, zip(inner[u, w], inner[w, y], inner[y, u], strict=True)))
                for k in (u, w, y):
                    tri[k].append(s)
    for r in features.assemble(v, e, 2023, 1).where("is_infra = 0").collect():
        assert (r.triangle_loop_count, r.triangle_loop_amount, r.triangle_loop_tx_count) == (len(tri[r.node]), sum(x for x, _ in tri[r.node]), sum(n for _, n in tri[r.node]))
        ego = near[r.node] | {r.node}
        m = sum(a in ego and b in ego and a != b for a, b in inner)
        assert (r.egonet_node_count, r.egonet_edge_count) == (len(ego), m)


def test_balances_and_degrees_add_up(spark, data_dir):
    n = features.node_features(N.network(spark, data_dir)[2]).agg(F.sum(F.col("balance_proxy").cast("decimal(38,0)")).alias("b"), F.sum("in_degree").alias("i"), F.sum("out_degree").alias("o")).first()
    assert n.b == 0 and n.i == n.o == 1248


def test_expected_values_of_the_fixture(spark, data_dir):
    d = data_dir.replace("sf0.001", "sf0.01")
    _, v, e = N.network(spark, d)
    r = v.agg(F.count("*").alias("n"), F.sum("is_infra").alias("i"), F.sum(F.col("node") * (F.expr("cast(substring(address, 3) as bigint)") % 1009)).alias("c")).first()
    assert (r.n, r.i, r.c) == (1549, 29, 533650701)
    inner = graph.without_infra(e)
    t = features.triangles(inner)
    assert [features.triangle_loops(t, m).agg(F.sum("triangle_loop_count")).first()[0] for m in ("ordered", "all")] == [3 * 282, 3 * 564]
    assert features.two_node_loops(inner).agg(F.sum("two_node_loop_count")).first()[0] == 155


def test_running_total_and_ranks(spark):
    values = [3.0, 1.0, 1.0, None, 2.0, 1.0, float("nan"), 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.r for r in average_rank(df, "v", "r").collect()}
    assert got == {0: 5.5, 1: 2.0, 2: 2.0, 3: None, 4: 4.0, 5: 2.0, 6: None, 7: 5.5}
    big = spark.range(1000).withColumn("w", F.col("id") % 5)
    assert all(r.before == sum(x % 5 for x in range(r.id)) for r in running_total(big, [F.col("id")], F.col("w")).where("id % 97 = 0").collect())
    assert average_rank(df.limit(0), "v", "r").count() == 0


@pytest.mark.parametrize("infra", [[], ["a"]])
def test_empty_graph(spark, infra):
    v, e, ids = build(spark, [], infra)
    assert ids == {} and features.assemble(v, e, 2023, 1).count() == 0


def test_transfers_left_out_for_their_amount_are_counted(spark):
    rows = [("a", "5"), ("b", None), ("c", ""), ("d", "1" + "0" * 38), ("e", " 00" + "9" * 38), ("f", "x"), ("g", "9" * 78), ("h", "9" * 79)]
    t = spark.createDataFrame(rows, "transfer_sid string, amount string")
    assert tuple(edgelist.dropped_amounts(t).first()) == (8, 4, 2)


def test_amounts_of_78_digits_go_through_the_graph_exactly(spark):
    """One value of 2^256 - 1 a transfer: sums, balance and loops keep every digit."""
    top, small = 2**256 - 1, 10**12
    rows = [("t1", "a", "b", str(top)), ("t2", "a", "b", str(top - 1)), ("t3", "b", "a", str(small)), ("t4", "b", "c", str(small - 1)), ("t5", "c", "c", str(10**40)), ("t6", "a", "b", "x")]
    e = spark.createDataFrame(rows, "transfer_sid string, from_address_sid string, to_address_sid string, amount string").withColumns({"timestamp": F.lit(1), "token_sid": F.lit("k"), "tx_sid": F.lit("x")})
    kept = edgelist.filter_edges(e)
    assert sorted(r.transfer_sid for r in kept.collect()) == ["t1", "t2", "t3", "t5"]
    p = graph.aggregate_edges(kept)
    assert {(r.from_sid, r.to_sid): r.amount for r in graph.with_amounts(p).collect()} == {("a", "b"): str(2 * top - 1), ("b", "a"): str(small), ("c", "c"): str(10**40)}
    v = graph.flag_infra(graph.number_vertices(p), spark.createDataFrame([(None,)], "address string"))
    t = {r.address: r for r in features.assemble(v, graph.numbered_edges(p, v), 2023, 1).collect()}
    assert (t["a"].total_output_amount, t["a"].balance_proxy, t["b"].balance_proxy) == (str(2 * top - 1), str(small - 2 * top + 1), str(2 * top - 1 - small))
    assert t["c"].balance_proxy == "0" and t["c"].two_node_loop_amount == 2e40 and t["a"].two_node_loop_amount == float(2 * top - 1 + small)
