"""Exact distinct counts by compressed bitmaps.

Identifiers are encoded as dense integers. The set of a group is a bitmap cut
into words of 64 identifiers, of which only those that aren't empty exist; data
is partitioned by word once, and every grouping of every combination is computed
where the words lie, because a word's identifiers are nowhere else. What moves
on are counts. There is no error at any size.

The form to keep is a row for each group and container of 2^16 identifiers, as
bytes in the smallest of three ways: the members themselves, a bitmap, or runs.
Containers merge by OR and AND as they are: rows of a container are sorted by
group and pass one accumulator of 8 KB.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

#: The stated bound of the relative error.
ERROR_BOUND = 0.0
WORD_BITS = 64
#: Buckets of the dictionary, at least; more where there are more shuffle partitions.
_BUCKETS = 1024
#: Identifiers of a container, its bytes as a bitmap, and the first byte of each of the three ways.
CONTAINER, BITMAP_BYTES = 1 << 16, 1 << 13
ARRAY, BITMAP, RUNS = 0, 1, 2


def encode(keys: DataFrame, known: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """key, id: a dense integer from 0 for each distinct non-null key (column 0 of keys).

    known: an earlier dictionary; its keys keep their integers and new ones
    follow, so that older bitmaps stay valid. The numbering depends on the keys
    only: rank in its hash bucket plus the sizes of the buckets before it
    (`buckets` numbers, which follow the shuffle partitions).
    """
    buckets = buckets or max(_BUCKETS, 8 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
    if known is not None:
        distinct = distinct.join(known.select("key"), "key", "left_anti")
    placed = distinct.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("key")) - 1)
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = F.lit(0).cast("bigint")
    if known is not None:
        last = known.agg(F.max("id")).first()[0]
        start = F.lit(0 if last is None else last + 1).cast("bigint")
    new = ranked.join(F.broadcast(offsets), "_b").select("key", (F.col("_r") + F.col("_before") + start).cast("bigint").alias("id"))
    return new if known is None else known.select("key", "id").unionByName(new)


def build(members: DataFrame, groups: list[str], key: str, dictionary: DataFrame) -> DataFrame:
    """groups, word, bits: the bitmap words of each group, from distinct (groups, key) rows."""
    coded = members.join(dictionary.select(F.col("key").alias(key), "id"), key)
    bit = F.expr(f"shiftleft(1L, cast(id % {WORD_BITS} as int))")
    words = coded.select(*groups, F.floor(F.col("id") / WORD_BITS).cast("bigint").alias("word"), bit.alias("bit"))
    return words.repartition("word").groupBy("word", *groups).agg(F.bit_or("bit").alias("bits"))


def to_bytes(bitmap: np.ndarray) -> bytes:
    """A container of BITMAP_BYTES bytes in its smallest form. Bit i of byte b is identifier 8 b + i."""
    ids = np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).astype("<u2")
    breaks = np.flatnonzero(np.diff(ids.astype(np.int64)) != 1)
    if 4 * (len(breaks) + 1) < min(2 * len(ids), BITMAP_BYTES):
        first, last = ids[np.append(0, breaks + 1)], ids[np.append(breaks, len(ids) - 1)]
        return bytes([RUNS]) + np.stack([first, last], axis=1).astype("<u2").tobytes()
    return bytes([BITMAP]) + bitmap.tobytes() if 2 * len(ids) > BITMAP_BYTES else bytes([ARRAY]) + ids.tobytes()


def to_bitmap(data: bytes) -> np.ndarray:
    """The bitmap of a container in any form."""
    if data[0] == BITMAP:
        return np.frombuffer(data, np.uint8, BITMAP_BYTES, 1)
    values = np.frombuffer(data, "<u2", -1, 1)
    bits = np.zeros(CONTAINER, np.uint8)
    if data[0] == ARRAY:
        bits[values] = 1
    else:
        for first, last in values.reshape(-1, 2):
            bits[first : int(last) + 1] = 1
    return np.packbits(bits, bitorder="little")


def _count(data: bytes) -> int:
    """Members of a container, without spreading it out."""
    if data[0] == ARRAY:
        return (len(data) - 1) // 2
    if data[0] == RUNS:
        r = np.frombuffer(data, "<u2", -1, 1).reshape(-1, 2).astype(np.int64)
        return int((r[:, 1] - r[:, 0] + 1).sum())
    return int(np.bitwise_count(np.frombuffer(data, np.uint64, -1, 1)).sum()) if len(data) > 1 else 0


def pack(words: DataFrame, groups: list[str]) -> DataFrame:
    """groups, container, data, n: the members of a group in one container of 65,536 identifiers, and how many; the form to store and to merge later."""
    per = CONTAINER // WORD_BITS
    held = words.groupBy(*groups, F.floor(F.col("word") / per).cast("bigint").alias("container")).agg(F.collect_list(F.struct((F.col("word") % per).cast("int").alias("w"), "bits")).alias("_w"))

    def squeeze(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for entries in b["_w"]:
                bitmap = np.zeros(per, "<i8")
                bitmap[[e["w"] for e in entries]] = [e["bits"] for e in entries]
                data.append(to_bytes(bitmap.view(np.uint8)))
            yield b.drop(columns="_w").assign(data=data, n=[_count(x) for x in data])

    schema = StructType([f for f in held.schema.fields if f.name != "_w"]).add("data", BinaryType()).add("n", LongType())
    return held.mapInPandas(squeeze, schema)


def merge(packed: DataFrame, groups: list[str], at_least: int = 1) -> DataFrame:
    """groups, container, data, n: the OR of all containers that agree on groups; the AND if at_least says how many there must be.

    For an AND, each group must have one row for each set it is made of
    (at_least of them); fewer mean that a set has no member there.
    """
    keys = [*groups, "container"]
    rows = packed.select(*keys, "data").repartition(*keys).sortWithinPartitions(*keys)
    schema = StructType([f for f in rows.schema.fields if f.name != "data"]).add("data", BinaryType()).add("n", LongType())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, seen = None, None, 0

        def done() -> list[tuple]:
            if key is None or seen < at_least or (at_least > 1 and not held.any()):
                return []
            data = single if seen == 1 else to_bytes(held)
            return [(*key, data, _count(data))]

        single = b""
        for b in batches:
            out = []
            values = list(zip(*[b[k].astype(object).where(b[k].notna(), None) for k in keys], strict=True))
            for now, data in zip(values, b["data"], strict=True):
                if now != key:
                    out += done()
                    key, single, seen, held = now, data, 1, None
                    continue
                if held is None:
                    held = to_bitmap(single).copy()
                other = to_bitmap(data)
                held = held & other if at_least > 1 else held | other
                seen += 1
            yield pd.DataFrame(out, columns=[*keys, "data", "n"])
        yield pd.DataFrame(done(), columns=[*keys, "data", "n"])

    return rows.mapInPandas(run, schema)


def unpack(packed: DataFrame, groups: list[str]) -> DataFrame:
    """groups, word, bits of packed containers."""
    per = CONTAINER // WORD_BITS

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bitmaps = [to_bitmap(x).view("<i8") for x in b["data"]]
            used = [np.flatnonzero(x) for x in bitmaps]
            at = np.repeat(np.arange(len(b)), [len(u) for u in used])
            word = b["container"].to_numpy()[at] * per + np.concatenate(used) if len(b) else []
            yield b[groups].iloc[at].reset_index(drop=True).assign(word=word, bits=np.concatenate([x[u] for x, u in zip(bitmaps, used, strict=True)]) if len(b) else [])

    schema = StructType([packed.schema[g] for g in groups]).add("word", LongType()).add("bits", LongType())
    return packed.select(*groups, "container", "data").mapInPandas(spread, schema)


def packed_count(packed: DataFrame, groups: list[str], name: str = "n") -> DataFrame:
    """The members of each group's set, from its containers (of which a group may have several, but none twice)."""
    return packed.groupBy(*groups).agg(F.sum("n").cast("bigint").alias(name))


def union(words: DataFrame, groups: list[str]) -> DataFrame:
    """The OR of all sets that agree on groups (fewer than the sets have)."""
    return words.groupBy("word", *groups).agg(F.bit_or("bits").alias("bits"))


def intersection(words: DataFrame, groups: list[str], which: Column, values: list) -> DataFrame:
    """The AND of the sets with which = each of values, for each of groups."""
    sides = [F.coalesce(F.bit_or(F.when(which == v, F.col("bits"))), F.lit(0).cast("bigint")).alias(f"_s{i}") for i, v in enumerate(values)]
    both = words.groupBy("word", *groups).agg(*sides)
    bits = F.col("_s0")
    for i in range(1, len(values)):
        bits = bits.bitwiseAND(F.col(f"_s{i}"))
    return both.select("word", *groups, bits.alias("bits")).where("bits <> 0")


def count(words: DataFrame, groups: list[str], name: str = "n") -> DataFrame:
    """The members of each group's set."""
    return words.groupBy(*groups).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(name))


def cube_counts(words: DataFrame, dims: list[str], role: str, names: dict[str, str]) -> DataFrame:
    """Distinct members for every combination of dims, a column for each role.

    words: dims, role, word, bits, partitioned by word. by_<dim> is 1 where the
    result is grouped by it, so a group whose value is NULL differs from "all".
    """
    masks = []
    for m in range(1 << len(dims)):
        on = [bool(m >> i & 1) for i in range(len(dims))]
        masks.append(F.struct(*[(F.col(d) if o else F.lit(None).cast(dict(words.dtypes)[d])).alias(d) for d, o in zip(dims, on, strict=True)], *[F.lit(int(o)).alias(f"by_{d}") for d, o in zip(dims, on, strict=True)]))
    by = [*dims, *[f"by_{d}" for d in dims]]
    spread = words.select("word", role, "bits", F.explode(F.array(*masks)).alias("_g")).select("word", role, "bits", *[F.col(f"_g.{c}").alias(c) for c in by])
    merged = spread.groupBy("word", role, *by).agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(role) == r, F.bit_count("bits"))), F.lit(0)).cast("bigint").alias(n) for r, n in names.items()])
