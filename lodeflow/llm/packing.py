"""Filling containers of fixed capacity with items.

Sizes are whole numbers up to the capacity, so an instance of any number of
items is a histogram of at most `capacity` rows. The Martello-Toth reduction
and best-fit decreasing both run on the histogram: a step settles all copies
of a choice at once, and its result is a short list of fillings with the
number of containers filled that way. Items find their container by their rank
among the items of their size.

Reduction: a set of items is fixed when it dominates every other set with the
same first item, that is when some optimal packing has it. Those are
  - an item that nothing else fits beside;
  - an item and another that fill the container exactly;
  - an item and the largest that fits, if no two others fit beside it;
  - the same if two fit but no three, and no pair is larger than that one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.session import ensure_checkpoint_dir

#: Parts into which the items of one size are cut for ranking, at least; more where there are more shuffle partitions.
RANK_PARTS = 64


class _Sizes:
    """Sizes and their numbers, in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.order[bisect_left(self.order, size)]

    def largest(self, room: int) -> int:
        """The largest size that fits, 0 if none."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest items' sizes, fewer if there are fewer."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum of two items that fits, 0 if none."""
        best, i, j = 0, 0, len(self.order) - 1
        while i <= j:
            s = self.order[i] + self.order[j]
            if s > room or (i == j and self.n[self.order[i]] < 2):
                j -= 1
            else:
                best = max(best, s)
                i += 1
        return best


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Fillings fixed by dominance, each with its number of containers, and the histogram that is left."""
    left, fixed = _Sizes(counts), []

    def fix(a: int, b: int, k: int) -> None:
        fixed.append(({a: 1} if not b else {a: 2} if a == b else {a: 1, b: 1}, k))
        left.take(a, 2 * k if a == b else k)
        if b and a != b:
            left.take(b, k)

    for s in reversed(list(left.order)):
        while left.n.get(s):
            room = capacity - s
            left.take(s, 1)  # the item itself is no partner
            small, partner = left.smallest(3), left.largest(room)
            alone = not small or small[0] > room
            dominant = partner and (partner == room or sum(small[:2]) > room or len(small) < 2 or ((len(small) < 3 or sum(small) > room) and partner >= left.best_pair(room)))
            left.n[s] = left.n.get(s, 0) + 1
            if left.n[s] == 1:
                insort(left.order, s)
            if alone:
                # Still true for every copy: other items only become fewer.
                only = left.smallest(2)
                fix(s, 0, left.n[s] if only[0] + s > capacity else 1)
            elif dominant:
                fix(s, partner, left.n[s] // 2 if s == partner else min(left.n[s], left.n[partner]))
            else:
                break
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing: fillings with their numbers of containers."""
    bins: dict[int, list] = defaultdict(list)  # room -> [(number, chain)]
    rooms: list[int] = []

    def put(room: int, number: int, chain: tuple) -> None:
        if not number:
            return
        if not bins[room]:
            insort(rooms, room)
        bins[room].append((number, chain))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                q = capacity // s
                put(capacity - q * s, n // q, (None, s, q))
                if n % q:
                    put(capacity - n % q * s, 1, (None, s, n % q))
                break
            room = rooms[i]
            number, chain = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[i]
            q = room // s
            full = min(number, n // q)
            put(room - q * s, full, (chain, s, q))
            n -= full * q
            rest = number - full
            if n and rest:
                put(room - n * s, 1, (chain, s, n))
                n, rest = 0, rest - 1
            put(room, rest, chain)
    out = []
    for groups in bins.values():
        for number, chain in groups:
            content: dict[int, int] = defaultdict(int)
            while chain:
                chain, s, q = chain
                content[s] += q
            out.append((dict(content), number))
    return out


#: Bits of a key for the rank among items of one size.
RANK_BITS = 40


@dataclass
class Plan:
    """Containers by size and rank: item `rank` of `size` goes to base + (rank - low) // each of its interval.

    sizes: the sizes there are; key: place of the size among them and rank.
    Bins below n_fixed are those that dominance has fixed.
    """

    sizes: np.ndarray
    key: np.ndarray
    low: np.ndarray
    each: np.ndarray
    base: np.ndarray
    n_bins: int
    n_fixed: int

    def find(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (np.searchsorted(self.sizes, size) << RANK_BITS) + rank, side="right") - 1
        return self.base[at] + (rank - self.low[at]) // self.each[at]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Pack a histogram (sizes from 1 to capacity)."""
    fixed, left = reduce(counts, capacity)
    fillings = fixed + best_fit(left, capacity)
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    sizes = sorted(s for s, n in counts.items() if n)
    place = {s: i for i, s in enumerate(sizes)}
    if len(sizes) >> (63 - RANK_BITS) or max(counts.values(), default=0) >> RANK_BITS:
        raise OverflowError("too many items of one size, or too many sizes")
    for content, number in fillings:
        for s, q in content.items():
            rows.append(((place[s] << RANK_BITS) + used[s], used[s], q, base))
            used[s] += q * number
        base += number
    if dict(used) != {s: n for s, n in counts.items() if n}:
        raise AssertionError("a size isn't packed in full")
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(np.array(sizes, dtype=np.int64), a[:, 0], a[:, 1], a[:, 2], a[:, 3], base, sum(k for _, k in fixed))


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", kind: str = "container", capacity: str = "capacity_tokens") -> DataFrame:
    """container, bin_no, key, piece_no, first_token, n_tokens, by_dominance: every item in a bin of every kind of container.

    An item above the capacity is cut into pieces of the capacity, each filling
    a bin, and a rest that is packed like an item; no other is split. Items of
    size 0 need no room and share bin 0. Bins are numbered from 0 for each kind.
    by_dominance: the bin was fixed by dominance (a full piece's always is), not
    filled by best fit. Kinds with a NULL or non-positive capacity are left out. key must be unique.
    """
    spark = items.sparkSession
    kinds = [(r[0], int(r[1])) for r in containers.select(kind, capacity).where(F.col(capacity) > 0).collect()]
    types = dict(items.dtypes)
    out = f"{kind} string, bin_no bigint, `{key}` {types[key]}, piece_no int, first_token bigint, n_tokens bigint, by_dominance boolean"
    if not kinds:
        return spark.createDataFrame([], out)
    ensure_checkpoint_dir(spark)
    sized = items.select(key, F.col(size).cast("bigint").alias("n")).checkpoint()
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).cast("bigint").alias("c")) for i, (_, c) in enumerate(kinds)]))
    cut = sized.select(key, "n", each.alias("_k")).select(key, "n", "_k.k", "_k.c").withColumn("full", F.when(F.col("n") > F.col("c"), F.floor(F.col("n") / F.col("c"))).otherwise(0).cast("bigint"))
    cut = cut.withColumn("rest", F.col("n") - F.col("full") * F.col("c"))
    part = F.pmod(F.xxhash64(key), F.lit(max(RANK_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))).cast("int")
    rests = cut.where("rest > 0").withColumn("_part", part)
    # One row per kind, size and part at most: bounded by the capacities, whatever the number of items.
    sizes = rests.groupBy("k", "rest", "_part").agg(F.count("*").alias("m"))
    histogram: list[dict[int, int]] = [{} for _ in kinds]
    for r in sizes.groupBy("k", "rest").agg(F.sum("m").alias("m")).collect():
        histogram[r.k][r.rest] = r.m
    plans = [plan(h, c) for h, (_, c) in zip(histogram, kinds, strict=True)]
    starts = sizes.withColumn("_start", F.coalesce(F.sum("m").over(Window.partitionBy("k", "rest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rests.withColumn("_r", F.row_number().over(Window.partitionBy("k", "rest", "_part").orderBy(key)) - 1)
    ranked = ranked.join(starts.drop("m"), ["k", "rest", "_part"]).select("k", key, (F.col("_r") + F.col("_start")).cast("bigint").alias("rank"), F.col("full").cast("int").alias("piece_no"), (F.col("full") * F.col("c")).alias("first_token"), F.col("rest").alias("n_tokens"))
    shared = spark.sparkContext.broadcast([(name, p) for (name, _), p in zip(kinds, plans, strict=True)])

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, g in b.groupby("k"):
                name, p = shared.value[int(k)]
                yield pd.DataFrame({kind: name, "bin_no": p.find(g.n_tokens.to_numpy(), g["rank"].to_numpy()), key: g[key], "piece_no": g.piece_no, "first_token": g.first_token, "n_tokens": g.n_tokens}).assign(by_dominance=lambda x: x.bin_no < p.n_fixed)

    placed = ranked.mapInPandas(place, out)
    # Full pieces need no plan: their bins follow the planned ones, in the order of hash parts.
    wide = cut.where("full > 0").withColumn("_part", part)
    ahead = wide.groupBy("k", "_part").agg(F.sum("full").alias("m")).withColumn("_start", F.coalesce(F.sum("m").over(Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    before = F.coalesce(F.sum("full").over(Window.partitionBy("k", "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = F.element_at(F.array(*[F.lit(n) for n, _ in kinds]), F.col("k") + 1)
    planned = F.element_at(F.array(*[F.lit(p.n_bins).cast("bigint") for p in plans]), F.col("k") + 1)
    pieces = wide.withColumn("_before", before).join(ahead, ["k", "_part"]).select("k", key, "c", (planned + F.col("_start") + F.col("_before")).alias("_bin"), F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece_no"))
    pieces = pieces.select(names.alias(kind), (F.col("_bin") + F.col("piece_no")).cast("bigint").alias("bin_no"), key, "piece_no", (F.col("piece_no") * F.col("c")).cast("bigint").alias("first_token"), F.col("c").alias("n_tokens"), F.lit(True).alias("by_dominance"))
    empty = cut.where("n = 0").select(names.alias(kind), F.lit(0).cast("bigint").alias("bin_no"), key, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(False).alias("by_dominance"))
    return placed.unionByName(pieces).unionByName(empty)


def fill_report(packed: DataFrame, containers: DataFrame, kind: str = "container", capacity: str = "capacity_tokens") -> DataFrame:
    """container, n_bins, n_fixed, n_tokens, fill, least_bins: bins used, those of them fixed by dominance, tokens in them, the filled share, and the bound no packing can go below."""
    total = packed.groupBy(kind).agg(F.countDistinct("bin_no").alias("n_bins"), F.countDistinct(F.when(F.col("by_dominance"), F.col("bin_no"))).alias("n_fixed"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    c = F.col(capacity)
    return total.join(containers.select(kind, capacity), kind).select(kind, capacity, "n_pieces", "n_bins", "n_fixed", "n_tokens", (F.col("n_tokens") / (F.col("n_bins") * c)).alias("fill"), F.ceil(F.col("n_tokens") / c).alias("least_bins"))
