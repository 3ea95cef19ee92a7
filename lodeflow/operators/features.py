"""Node, motif and egonet features of the transfer graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.uint256 import LIMBS, limbs, names, sums, to_text
from lodeflow.operators.graph import without_infra
from lodeflow.schemas import EGONET_FEATURES, ID_COLUMNS, MOTIF_FEATURES, NODE_FEATURES
from lodeflow.session import stored

_WIDE = "decimal(38,0)"


def node_features(edges: DataFrame) -> DataFrame:
    """node and NODE_FEATURES of every vertex with an edge; edges to infrastructure count. Amounts are exact, as text."""
    zero, none = F.lit(0).cast("bigint"), [F.lit(0).cast(_WIDE)] * 3
    mine, ins, outs = limbs(), names("i_"), names("o_")

    def end(node: str, i: int, o: int):
        amounts = (mine if i else none), (mine if o else none)
        counts = F.col("count") if i else zero, F.col("count") if o else zero
        named = zip((*ins, *outs), (*amounts[0], *amounts[1]), strict=True)
        return F.struct(F.col(node).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"), counts[0].alias("ic"), counts[1].alias("oc"), *[c.alias(n) for n, c in named])

    e = edges.select(F.explode(F.array(end("dst", 1, 0), end("src", 0, 1))).alias("e")).select("e.*")
    g = e.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("i", "o", "ic", "oc")], *sums("i_"), *sums("o_"))
    balance = [(a - b).cast(_WIDE) for a, b in zip(limbs("i_"), limbs("o_"), strict=True)]
    amounts = to_text(*limbs("i_")).alias("total_input_amount"), to_text(*limbs("o_")).alias("total_output_amount"), to_text(*balance).alias("balance_proxy")
    return g.select("node", F.col("i").alias("in_degree"), F.col("o").alias("out_degree"), F.col("ic").alias("in_transfer_count"), F.col("oc").alias("out_transfer_count"), *amounts)


def two_node_loops(edges: DataFrame) -> DataFrame:
    """node, self_loop_count and the two_node_loop features; a self-loop also counts as a loop of two, with both amounts.

    Both directions of a pair meet in one group of the unordered pair, so no
    self-join is needed and hubs don't gather. The amount is exact, as text.
    """
    up = F.col("src") <= F.col("dst")
    pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_if(up).alias("n_up"), F.count_if(~up).alias("n_down"), *sums(), F.sum("count").alias("count"))
    loop, mutual = F.col("a") == F.col("b"), (F.col("n_up") > 0) & (F.col("n_down") > 0)
    ends = F.when(loop, F.array("a")).otherwise(F.array("a", "b"))
    double = F.when(loop, 2).otherwise(1)
    amounts = [(c * double).cast(_WIDE).alias(n) for n, c in zip(LIMBS, limbs(), strict=True)]
    rows = pair.where(loop | mutual).select(F.explode(ends).alias("node"), loop.cast("bigint").alias("s"), *amounts, (F.col("count") * double).alias("count"))
    n = rows.groupBy("node").agg(F.max("s").alias("self_loop_count"), F.count("*").alias("two_node_loop_count"), *sums(), F.sum("count").alias("two_node_loop_tx_count"))
    return n.select("node", "self_loop_count", "two_node_loop_count", to_text(*limbs()).alias("two_node_loop_amount"), "two_node_loop_tx_count")


def triangles(edges: DataFrame) -> DataFrame:
    """Undirected triangles x < y < z, each once, with what runs on each side in either direction.

    Sides are ab for the pair (a, b), forward a to b: columns xy_f, xy_b, yz_f,
    ... as structs (n, limbs of the amount, count), n 0 or 1. Pairs point from
    lower to higher (degree, node), so wedges number at most the pairs to the
    power 1.5, whatever the hubs. Pairs, pointed pairs and triangles are stored,
    as each serves several joins.
    """
    flat = edges.where("src <> dst")
    up = F.col("src") < F.col("dst")

    def side(cond: Column) -> Column:
        amounts = [F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast(_WIDE).alias(c) for c in LIMBS]
        return F.struct(F.count_if(cond).alias("n"), *amounts, F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).cast("bigint").alias("count"))

    pairs = stored(flat.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(side(up).alias("f"), side(~up).alias("g")), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    known = pairs.select("a", "b").join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    swap = F.col("da") > F.col("db")
    out = stored(known.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v")), "pointed")
    # A wedge's ends meet under u; the shuffle is asked for, since this join multiplies rows and shouldn't run in the few tasks of its input.
    one = out.select("u", F.col("v").alias("v1"))
    two = out.select("u", F.col("v").alias("v2")).hint("merge")
    wedges = one.join(two, "u").where("v1 < v2").select("u", F.col("v1").alias("a"), F.col("v2").alias("b"))
    closed = wedges.join(pairs.select("a", "b"), ["a", "b"])
    low, high = F.least("u", "a", "b"), F.greatest("u", "a", "b")
    found = closed.select(low.alias("x"), (F.col("u") + F.col("a") + F.col("b") - low - high).alias("y"), high.alias("z"))

    def with_side(df: DataFrame, p: str, q: str) -> DataFrame:
        return df.join(pairs.select(F.col("a").alias(p), F.col("b").alias(q), F.col("f").alias(f"{p}{q}_f"), F.col("g").alias(f"{p}{q}_b")), [p, q])

    return stored(with_side(with_side(with_side(found, "x", "y"), "y", "z"), "x", "z"), "triangles")


def triangle_loops(tri: DataFrame, cycle_mode: str = "ordered") -> DataFrame:
    """node and the triangle_loop features; the amount is exact, as text.

    cycle_mode "ordered": only cycles that rise twice in node order and return,
    as the pipeline defines them; "all": cycles of either orientation.
    """
    ways = [("xy_f", "yz_f", "xz_b")] + [("xz_f", "yz_b", "xy_b")] * (cycle_mode == "all")

    def cycle(sides: tuple[str, str, str]) -> Column:
        n = F.col(f"{sides[0]}.n") * F.col(f"{sides[1]}.n") * F.col(f"{sides[2]}.n")
        add = lambda c: F.col(f"{sides[0]}.{c}") + F.col(f"{sides[1]}.{c}") + F.col(f"{sides[2]}.{c}")
        return F.struct(n.alias("n"), *[add(c).cast(_WIDE).alias(c) for c in LIMBS], add("count").alias("count"))

    rows = tri.select(F.array("x", "y", "z").alias("_v"), F.explode(F.array(*[cycle(w) for w in ways])).alias("c")).where("c.n > 0").select(F.explode("_v").alias("node"), "c.*")
    n = rows.groupBy("node").agg(F.count("*").alias("triangle_loop_count"), *sums(), F.sum("count").alias("triangle_loop_tx_count"))
    return n.select("node", "triangle_loop_count", to_text(*limbs()).alias("triangle_loop_amount"), "triangle_loop_tx_count")


def egonets(edges: DataFrame, tri: DataFrame) -> DataFrame:
    """node and EGONET_FEATURES of vertices with an edge: the neighbours and itself, and the directed edges among them."""
    flat = edges.where("src <> dst")
    ends = flat.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"))
    per_pair = ends.groupBy("e.node", "e.other").agg(F.count("*").alias("m"))
    around = per_pair.groupBy("node").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    opposite = lambda v, s: F.struct(F.col(v).alias("node"), (F.col(f"{s}_f.n") + F.col(f"{s}_b.n")).alias("m"))
    inner = tri.select(F.explode(F.array(opposite("x", "yz"), opposite("y", "xz"), opposite("z", "xy"))).alias("e")).groupBy("e.node").agg(F.sum("e.m").alias("m"))
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("m"))
    total = around.unionByName(inner.select("node", F.lit(0).cast("bigint").alias("n"), "m")).unionByName(alone).groupBy("node").agg((F.sum("n") + 1).alias("n"), F.sum("m").alias("m"))
    return total.select("node", F.col("n").alias("egonet_node_count"), F.col("m").alias("egonet_edge_count"), F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("egonet_density"))


def assemble(vertices: DataFrame, edges: DataFrame, year: int, month: int, cycle_mode: str = "ordered") -> DataFrame:
    """The feature table of 23 columns; infrastructure accounts have NULL features, others 0 where nothing was found.

    Total amounts and the balance are exact digits as text, those of loops doubles.
    """
    inner = without_infra(edges)
    tri = triangles(inner)
    node, loops, cycles, ego = node_features(edges), two_node_loops(inner), triangle_loops(tri, cycle_mode), egonets(inner, tri)
    all_ = vertices.select("node", "address", "is_infra").join(node, "node", "left").join(loops, "node", "left").join(cycles, "node", "left").join(ego, "node", "left")
    types = dict(all_.dtypes)
    shown = F.col("is_infra") == 0

    def value(c: str) -> Column:
        none = F.lit(1 if c == "egonet_node_count" else 0).cast(types[c])
        v = F.when(shown, F.coalesce(F.col(c), none))
        return (v.cast("double") if c in ("two_node_loop_amount", "triangle_loop_amount") else v).alias(c)

    extra = {"chain_id": F.lit(1), "year": F.lit(year), "month": F.lit(month)}
    return all_.select(*[extra[c].alias(c) if c in extra else F.col(c) for c in ID_COLUMNS], *[value(c) for c in (*NODE_FEATURES, *MOTIF_FEATURES, *EGONET_FEATURES)])
