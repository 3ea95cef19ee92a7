"""Isolation forest: trees are grown in parallel on seeded samples, rows are scored by groups of trees."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.session import stored
from lodeflow.sources.tables import spread

#: As in the reference: a tree's sample are all rows up to 100,000.
TREES, SAMPLE, SEED = 300, 100_000, 42
#: Nodes of the trees that are sent to the executors at once (18 bytes each).
GROUP_NODES = 3_000_000
EULER = 0.5772156649


def expected_path(m: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among m points."""
    m = np.asarray(m, dtype=float)
    big = np.maximum(m, 2.0)
    return np.where(m > 2, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big, np.where(m == 2, 1.0, 0.0))


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays: feature (-1 at leaves), split, left, right, path length at leaves.

    All nodes of a level are split at once: rows lie sorted by node, so a
    node's bounds are reductions over its stretch of rows.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    start, n_nodes, level = np.zeros(1, dtype=np.int64), 1, 0
    while True:
        size = np.diff(np.append(start, len(x)))
        feature, split = np.full(len(size), -1), np.zeros(len(size))
        left, right = np.full(len(size), -1), np.full(len(size), -1)
        if level < depth and len(x):
            lo, hi = np.minimum.reduceat(x, start, axis=0), np.maximum.reduceat(x, start, axis=0)
            wide = hi > lo
            # A random one of the columns that vary in the node: the largest of random keys.
            pick = np.where(wide, rng.random(wide.shape), -1.0).argmax(axis=1)
            at = np.arange(len(size))
            u, inner = rng.random(len(size)), wide.any(axis=1)
            cut = lo[at, pick] + u * (hi[at, pick] - lo[at, pick])
            # Rounding may not put all rows on one side.
            cut = np.where(cut <= lo[at, pick], hi[at, pick], cut)
            feature, split = np.where(inner, pick, -1), np.where(inner, cut, 0.0)
            child = n_nodes + 2 * (np.cumsum(inner) - 1)
            left, right = np.where(inner, child, -1), np.where(inner, child + 1, -1)
        parts.append((feature, split, left, right, np.where(feature < 0, level + expected_path(size), 0.0)))
        inner = feature >= 0
        if not inner.any():
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        node = np.repeat(np.arange(len(size)), size)
        stays = inner[node]
        x, node = x[stays], node[stays]
        above = x[np.arange(len(x)), feature[node]] >= split[node]
        rank = (np.cumsum(inner) - 1)[node] * 2 + above
        order = np.argsort(rank, kind="stable")
        x, rank = x[order], rank[order]
        start = np.searchsorted(rank, np.arange(2 * int(inner.sum())))
        n_nodes += 2 * int(inner.sum())
        level += 1


def packed(tree) -> bytes:
    """A tree's nodes as bytes; an inner node's split and a leaf's path length share a place."""
    feature, split, left, right, path = (np.array(a) for a in tree)
    return b"".join((np.where(feature < 0, path, split).astype("<f8").tobytes(), left.astype("<i4").tobytes(), right.astype("<i4").tobytes(), feature.astype("<i2").tobytes()))


def unpacked(data: bytes):
    n = len(data) // 18
    value = np.frombuffer(data, "<f8", n)
    return np.frombuffer(data, "<i2", n, 16 * n), value, np.frombuffer(data, "<i4", n, 8 * n), np.frombuffer(data, "<i4", n, 12 * n), value


def tree_groups(nodes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """First and last tree of each group of at most `most` nodes (or of one tree), from (tree, nodes) by tree."""
    out, held = [], 0
    for tree, n in nodes:
        if out and held + n <= most:
            out[-1], held = (out[-1][0], tree), held + n
        else:
            out.append((tree, tree))
            held = n
    return out


def path_lengths(x: np.ndarray, tree) -> np.ndarray:
    feature, split, left, right, path = tree
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        f = feature[at]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return path[at]
        i = at[inner]
        at[inner] = np.where(x[inner, feature[i]] < split[i], left[i], right[i])


def isolation_scores(df: DataFrame, key: str, columns: list[str], name: str = "iforest_score", trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, group_nodes: int = GROUP_NODES) -> DataFrame:
    """key and the score: 2^(-mean path / expected path) - 0.5, higher for rows easier to isolate.

    Rows with a NULL among the columns have a NULL score; without usable
    columns all scores are 0. Each row has one place on a circle, the hash of its
    key, and each tree takes the rows of an arc that begins at its own place, so
    drawing costs as much as the samples hold and the result doesn't depend on
    partitioning. Trees are grown in their tasks and stored; groups of at most
    group_nodes nodes go to the executors one after the other, each adding its
    path lengths to the rows, so memory depends on neither table nor sample.
    """
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    whole = rows.dropna(subset=list(columns)) if columns else rows.limit(0)
    n = whole.count()
    if not n or not columns:
        return rows.select(key, (F.lit(None) if columns else F.lit(0.0)).cast("double").alias(name))
    psi = min(sample, n)
    depth = max(1, math.ceil(math.log2(max(psi, 2))))
    place = F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    spark = df.sparkSession

    def tree(number: int, x: np.ndarray) -> pd.DataFrame:
        t = grow(x, depth, np.random.default_rng([seed, number]))
        return pd.DataFrame({"tree": [number], "nodes": [len(t[0])], "data": [packed(t)]})

    kind = "tree int, nodes int, data binary"
    if n <= sample:
        # Every tree takes all rows, at most `sample` of them: they are sent once, not copied for each tree.
        every = whole.withColumn("_u", place).orderBy("_u", key).select(*columns).toPandas().to_numpy(float)
        held = spark.sparkContext.broadcast(every)

        def plant(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield from (tree(int(i), held.value) for i in b["id"])

        grown = stored(spark.range(0, trees, 1, min(trees, max(1, 2 * spark.sparkContext.defaultParallelism))).mapInPandas(plant, kind), "trees")
        held.unpersist()
    else:
        # An arc that holds somewhat more than the sample; then exactly the nearest rows in each tree's task.
        share = min(1.0, psi / n + 6 * math.sqrt(psi) / n + 1e-9)
        last = F.floor(F.col("_u") * trees)
        drawn = F.sequence(last - min(int(share * trees) + 1, trees - 1), last)
        far = lambda t: F.pmod(F.col("_u") - t / F.lit(float(trees)), F.lit(1.0))
        chosen = F.transform(drawn, lambda t: F.struct(F.pmod(t, F.lit(trees)).cast("int").alias("tree"), far(t).alias("h")))
        sampled = whole.withColumn("_u", place).select(key, *columns, F.explode(F.filter(chosen, lambda s: s["h"] <= F.lit(share))).alias("_s")).select(key, *columns, "_s.tree", "_s.h")

        def train(g: pd.DataFrame) -> pd.DataFrame:
            return tree(int(g.tree.iat[0]), g.sort_values(["h", key]).head(psi)[columns].to_numpy(float))

        grown = stored(sampled.groupBy("tree").applyInPandas(train, kind), "trees")
    sizes = sorted((r.tree, r.nodes) for r in grown.select("tree", "nodes").collect())
    norm = float(expected_path(np.array([psi]))[0]) or 1.0
    names = [key, *columns, "_path"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _path double"

    def adder(shared):
        def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest = [unpacked(t) for t in shared.value]
            for b in batches:
                x = b[columns].to_numpy(float)
                known = ~np.isnan(x).any(axis=1)
                total = b["_path"].to_numpy(float, copy=True)
                if known.any():
                    total[known] += sum(path_lengths(x[known], t) for t in forest)
                yield b.assign(_path=total)[names]

        return add

    scored = spread(rows, key).withColumn("_path", F.lit(0.0))
    held = None
    for first, last in tree_groups(sizes, group_nodes):
        if held is not None:
            scored = stored(scored)
            held.unpersist()
        held = spark.sparkContext.broadcast([bytes(r.data) for r in grown.where(F.col("tree").between(first, last)).orderBy("tree").collect()])
        scored = scored.mapInPandas(adder(held), schema)
    whole_row = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns])
    mean = F.col("_path") / F.lit(float(len(sizes)))
    return scored.select(key, F.when(whole_row, F.pow(F.lit(2.0), -mean / F.lit(norm)) - 0.5).alias(name))
