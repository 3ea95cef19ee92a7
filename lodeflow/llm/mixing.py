"""Mixing sources to target weights.

The total is the largest at which every source can reach its share within its
cap of repeats. A source that must contribute f copies of its documents gives
each floor(f) times for certain and once more with probability f - floor(f);
which ones get the extra copy is drawn by the cube method, balanced on the
number of documents and on tokens. The flight phase moves three undecided
documents at a time along the null space of those two constraints until one is
decided; it runs in blocks of bounded size, whose undecided rests (two each)
are gathered in further rounds. At most two documents per source are left for
the landing phase, which takes the choice closest to the target and balances
what a large document among them leaves over.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.session import ensure_checkpoint_dir

#: Documents of a block of the flight phase, and blocks whose rests are gathered in one further block.
BLOCK = 4096
FAN_IN = 64
#: Decided documents that each block sends along for exchanges in the landing phase.
COMPANIONS = 64


def fly(sizes: Sequence[int], p: list[float], seed: str) -> list[float]:
    """Move probabilities until at most two are strictly between 0 and 1; their sum and their size-weighted sum stay the same."""
    rng = random.Random(seed)
    p = list(p)
    open_ = lambda i: 1e-9 < p[i] < 1 - 1e-9
    waiting = [i for i in range(len(p)) if open_(i)]
    waiting.reverse()
    hand: list[int] = []
    while True:
        while len(hand) < 3 and waiting:
            hand.append(waiting.pop())
        if len(hand) == 3:
            a, b, c = (sizes[i] for i in hand)
            move = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
        elif len(hand) == 2 and sizes[hand[0]] == sizes[hand[1]]:
            move = (1, -1)
        else:
            break
        up = min(((1 - p[i]) / m if m > 0 else p[i] / -m) for i, m in zip(hand, move, strict=True) if m)
        down = min((p[i] / m if m > 0 else (1 - p[i]) / -m) for i, m in zip(hand, move, strict=True) if m)
        step = up if rng.random() * (up + down) < down else -down
        for i, m in zip(hand, move, strict=True):
            p[i] += step * m
        hand = [i for i in hand if open_(i)]
    return [min(1.0, max(0.0, round(x) if not 1e-9 < x < 1 - 1e-9 else x)) for x in p]


def land(sizes: Sequence[int], p: list[float], swaps: int = 8) -> list[float]:
    """Decide the last ones and settle what they leave of the token balance.

    First the choice whose tokens, then number, come closest to what is
    expected. A large document among them can't be balanced by the others, so
    the difference is then worked off by exchanging a taken document of this
    group for one that isn't, as long as that helps.
    """
    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    want, number = sum(sizes[i] * p[i] for i in rest), sum(p[i] for i in rest)
    choices = range(1 << len(rest))
    miss = lambda m: (abs(sum(sizes[i] for k, i in enumerate(rest) if m >> k & 1) - want), abs(m.bit_count() - number), m)
    best = min(choices, key=miss)
    p = list(p)
    for k, i in enumerate(rest):
        p[i] = float(best >> k & 1)
    over = sum(sizes[i] for k, i in enumerate(rest) if best >> k & 1) - want
    for _ in range(swaps):
        out = sorted((sizes[i], i) for i, x in enumerate(p) if not x)
        closest = (abs(over), 0, -1, -1)
        for i, x in enumerate(p):
            at = bisect.bisect_left(out, (sizes[i] - over, -1)) if x else 0
            for z, j in out[max(0, at - 1) : at + 1] if x else ():
                closest = min(closest, (abs(over - sizes[i] + z), 1, i, j))
        _, found, i, j = closest
        if not found:
            break
        p[i], p[j] = 0.0, 1.0
        over += sizes[j] - sizes[i]
    return p


def companions(n: int) -> np.ndarray:
    """Positions among n documents from large to small: half of them the largest, half spread evenly."""
    return np.unique(np.concatenate([np.arange(min(n, COMPANIONS // 2)), np.linspace(0, n - 1, COMPANIONS // 2).astype(int)]))


def shares(stock: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """The total size, and the copies per document of each source.

    stock: source -> (documents, tokens). targets: source -> (share, cap). A
    target without tokens can't be met; the others keep their proportions.
    """
    usable = {s: (w, cap, stock[s][1]) for s, (w, cap) in targets.items() if w > 0 and cap > 0 and stock.get(s, (0, 0))[1] > 0}
    if not usable:
        return 0.0, {}
    total = min(cap * tokens / w for w, cap, tokens in usable.values())
    return total, {s: min(float(cap), total * w / tokens) for s, (w, cap, tokens) in usable.items()}


def mix(items: DataFrame, targets: DataFrame, seed: int = 7, key: str = "doc_id", source: str = "source", size: str = "n_tokens", share: str = "target_share", cap: str = "max_repeats") -> DataFrame:
    """key, source, n_tokens, copies (at least 1): what to take.

    No document is taken more than its source's cap. Items without a source or
    of a source without a target are not taken; a cap of NULL is 1, and of
    several targets of one source one counts. The same
    seed gives the same mixture, however the data is partitioned. key must be unique.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    held = items.select(key, source, F.col(size).cast("bigint").alias("n_tokens")).where(F.col(source).isNotNull()).checkpoint()
    wanted = {r[0]: (float(r[1] or 0), 1 if r[2] is None else int(r[2])) for r in targets.select(source, share, cap).collect() if r[0] is not None}
    # As many rows as there are targets.
    stock = {r[0]: (r.n, r.t) for r in held.where(F.col(source).isin(list(wanted))).groupBy(source).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    _, copies = shares(stock, wanted)
    out = f"`{key}` {dict(items.dtypes)[key]}, {source} string, n_tokens bigint, copies int"
    if not copies:
        return spark.createDataFrame([], out)
    each = spark.createDataFrame([(s, int(f + 1e-9), max(0.0, f - int(f + 1e-9)), max(1, -(-stock[s][0] // BLOCK))) for s, f in copies.items()], f"{source} string, _whole int, _p double, _blocks int")
    drawn = held.join(F.broadcast(each), source)
    certain = drawn.where("_p <= 1e-9")
    state = drawn.where("_p > 1e-9").withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("_blocks")).cast("int"))
    kept = [c for c in state.columns if c not in ("_p", "_block", "_blocks")]
    schema = f"{source} string, `{key}` {dict(items.dtypes)[key]}, n_tokens bigint, _whole int, _blocks int, _p double, _block int, _carry boolean"
    width, level, decided = max(-(-stock[s][0] // BLOCK) for s in copies), 0, None

    def round_of(last: bool, level: int):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            # Large ones first: those that meet are alike, and the last undecided ones are small.
            g = g.sort_values(["n_tokens", key], ascending=[False, True])
            p = fly(g.n_tokens.tolist(), g["_p"].tolist(), f"{seed}/{level}/{g[source].iat[0]}/{g['_block'].iat[0]}")
            g["_p"] = land(g.n_tokens.tolist(), p) if last else p
            g["_carry"] = (g["_p"] > 0) & (g["_p"] < 1)
            if not last:
                g.iloc[companions(len(g)), g.columns.get_loc("_carry")] = True
            return g[[source, key, "n_tokens", "_whole", "_blocks", "_p", "_block", "_carry"]]

        return run

    while True:
        last = width == 1
        state = state.groupBy(source, "_block").applyInPandas(round_of(last, level), schema)
        if not last:
            state = state.checkpoint()
        done = state if last else state.where("not _carry")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        width, level = -(-width // FAN_IN), level + 1
        state = state.where("_carry").drop("_carry").withColumn("_block", F.lit(0) if width == 1 else F.floor(F.col("_block") / FAN_IN).cast("int"))
    all_ = certain.select(*kept, F.lit(0.0).alias("_p")).unionByName(decided.select(*kept, "_p"))
    return all_.select(key, source, "n_tokens", (F.col("_whole") + F.col("_p").cast("int")).cast("int").alias("copies")).where("copies > 0")


def report(mixture: DataFrame, items: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share", cap: str = "max_repeats") -> DataFrame:
    """source, target_share, actual_share, n_tokens, n_documents, most_copies, stock_tokens: one row per source with a target or documents (NULL: none given)."""
    taken = mixture.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.sum("copies").cast("bigint").alias("n_documents"), F.max("copies").alias("most_copies"))
    stock = items.groupBy(source).agg(F.sum("n_tokens").alias("stock_tokens"))
    total = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).first().t or 0
    rows = stock.join(targets.select(source, share, cap), source, "full").join(taken, source, "left")
    none = F.lit(0).cast("bigint")
    return rows.select(source, share, cap, F.when(F.lit(total) > 0, F.coalesce("n_tokens", none) / F.lit(total)).otherwise(0.0).alias("actual_share"), F.coalesce("n_tokens", none).alias("n_tokens"), F.coalesce("n_documents", none).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("stock_tokens", none).alias("stock_tokens"))
