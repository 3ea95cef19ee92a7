import random
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeflow.llm import bitmaps as B


def rows(n=900, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["d1", "d2", None]), rng.choice(["x", "y"]), rng.choice(["s", "r"]), "hot" if rng.random() < 0.3 else f"k{rng.randrange(300)}") for _ in range(n)]


def words(spark, data):
    df = spark.createDataFrame(data, "day string, cat string, role string, key string").where("key IS NOT NULL").distinct()
    return B.build(df, ["day", "cat", "role"], "key", B.encode(df.select("key")))


def test_dictionary_is_dense_and_can_grow(spark):
    keys = [f"k{i}" for i in range(500)] + ["k1", None, "", "x" * 9000]
    one = B.encode(spark.createDataFrame([(k,) for k in keys], "name string")).collect()
    assert sorted(r.id for r in one) == list(range(502)) and len({r.key for r in one}) == 502
    known = spark.createDataFrame(one)
    two = {r.key: r.id for r in B.encode(spark.createDataFrame([("k3",), ("new",), ("newer",)], "name string"), known).collect()}
    assert {r.key: r.id for r in one}.items() <= two.items() and {two["new"], two["newer"]} == {502, 503}
    first = spark.createDataFrame([("a", 0)], "key string, id bigint")
    assert {r.key: r.id for r in B.encode(spark.createDataFrame([("a",), ("b",)], "name string"), first).collect()} == {"a": 0, "b": 1}
    empty = spark.createDataFrame([], "key string, id bigint")
    assert [r.id for r in B.encode(spark.createDataFrame([("a",)], "name string"), empty).collect()] == [0]


def test_every_combination(spark):
    data = rows()
    got = {(r.day, r.cat, r.by_day, r.by_cat): (r.n_s, r.n_r) for r in B.cube_counts(words(spark, data), ["day", "cat"], "role", {"s": "n_s", "r": "n_r"}).collect()}
    want = {}
    for by_day, by_cat in product((0, 1), repeat=2):
        for d, c, _, _ in data:
            k = (d if by_day else None, c if by_cat else None, by_day, by_cat)
            want[k] = tuple(len({x for a, b, w, x in data if w == role and (not by_day or a == d) and (not by_cat or b == c)}) for role in "sr")
    assert got == want


def test_merging_packed_states(spark):
    data = rows()
    packed = B.pack(words(spark, data), ["day", "cat", "role"])
    back = B.unpack(packed, ["day", "cat", "role"])
    got = {r.role: r.n for r in B.count(B.union(back, ["role"]), ["role"]).collect()}
    assert got == {w: len({x for _, _, r, x in data if r == w}) for w in "sr"}
    both = {r.day: r.n for r in B.count(B.intersection(B.union(back, ["day", "role"]), ["day"], F.col("role"), ["s", "r"]), ["day"]).collect()}
    assert both == {d: len({x for a, _, r, x in data if a == d and r == "s"} & {x for a, _, r, x in data if a == d and r == "r"}) for d in ("d1", "d2", None)}


def test_empty(spark):
    w = words(spark, [])
    assert B.cube_counts(w, ["day", "cat"], "role", {"s": "n"}).count() == 0 and B.pack(w, ["day", "cat", "role"]).count() == 0


def bitmap(ids):
    bits = np.zeros(B.CONTAINER, np.uint8)
    bits[list(ids)] = 1
    return np.packbits(bits, bitorder="little")


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=60), st.lists(st.tuples(st.integers(0, 65535), st.integers(1, 9000)), max_size=4), st.booleans())
def test_containers_round_trip_in_the_smallest_form(ids, stretches, dense):
    ids |= {i for a, n in stretches for i in range(a, min(a + n, 65536))} | (set(range(0, 65536, 3)) if dense else set())
    data = B.to_bytes(bitmap(ids))
    assert set(np.flatnonzero(np.unpackbits(B.to_bitmap(data), bitorder="little"))) == ids and B._count(data) == len(ids)
    assert len(data) <= 1 + min(2 * len(ids), B.BITMAP_BYTES)


def test_forms():
    assert [B.to_bytes(bitmap(x))[0] for x in ({1, 5, 9}, range(0, 65536, 2), range(60_000))] == [B.ARRAY, B.BITMAP, B.RUNS]


def test_containers_merge_as_they_are(spark):
    data = rows(3000, 7)
    packed = B.pack(words(spark, data), ["day", "cat", "role"])
    by_day = B.merge(packed, ["day", "role"])
    got = {(r.day, r.role): r.n for r in B.packed_count(by_day, ["day", "role"]).collect()}
    assert got == {(d, w): len({x for a, _, r, x in data if (a, r) == (d, w)}) for d in ("d1", "d2", None) for w in "sr"}
    both = {r.day: r.n for r in B.packed_count(B.merge(by_day, ["day"], at_least=2), ["day"]).collect()}
    assert both == {d: len({x for a, _, r, x in data if a == d and r == "s"} & {x for a, _, r, x in data if a == d and r == "r"}) for d in ("d1", "d2", None)}
    assert B.merge(packed.limit(0), ["day"]).count() == 0


def test_state_takes_less_than_eight_bytes_a_member(spark):
    packed = B.pack(words(spark, rows(4000, 2)), ["day", "cat", "role"]).select(F.sum(F.length("data")).alias("b"), F.sum("n").alias("n")).first()
    assert packed.b / packed.n < 8
