from datetime import datetime, timedelta

import pytest

from lodeflow.operators.orphans import Child, Parent, find_orphans, orphan_counts

T = datetime(2023, 1, 1)
CHILD, PARENT = "id string, fk string, fk2 string, t timestamp, ref_sid string", "key string, t timestamp, status string"


def day(n):
    return T + timedelta(days=n)


def run(spark, children, parents, removed=(), parents2=()):
    c = spark.createDataFrame(children, CHILD)
    p = Parent(spark.createDataFrame(parents, PARENT), "key", "t", spark.createDataFrame([(x,) for x in removed], "k string"))
    q = Parent(spark.createDataFrame(list(parents2), PARENT), "key", "t")
    return find_orphans(Child(c, "child", "id", "t", {"fk": p, "fk2": q}))


def test_every_status_once(spark):
    children = [
        ("a", "P1", "q", day(3), "x"), (" A ", "p1 ", "q", day(1), "x"),  # two rows of one record; the parent came between
        ("b", "p1", "q", day(4), None), ("c", "gone", None, day(1), None), ("d", "none", None, day(1), None), ("d", "none", None, day(1), None),
        ("e", None, None, day(1), None), (None, "none", None, day(1), None), ("f", "", None, day(1), None), ("g", "p1", "absent", None, None),
    ]
    parents = [("p1", day(2), "s"), ("P1", day(5), "s"), ("gone", day(0), "s"), (None, day(0), "s")]
    got = run(spark, children, parents, ["GONE ", None], [("q", day(0), "s")]).select("record_sid", "ref_field", "status").collect()
    assert sorted(map(tuple, got)) == [("a", "fk", "late"), ("c", "fk", "removed"), ("d", "fk", "missing"), ("f", "fk", "missing"), ("g", "fk2", "missing")]


def test_hot_key_and_counts(spark):
    children = [(f"r{i}", "hot", "q", day(i % 2), None) for i in range(500)]
    o = run(spark, children, [("other", day(0), "s")], parents2=[("q", day(0), "s")])
    assert sorted(map(tuple, orphan_counts(o).select("status", "period", "n_orphans", "n_keys").collect())) == [("missing", day(0).date(), 250, 1), ("missing", day(1).date(), 250, 1)]


@pytest.mark.parametrize("which", ["children", "parents"])
def test_empty_tables(spark, which):
    got = run(spark, [] if which == "children" else [("a", "x", None, day(0), None)], [("x", day(0), "s")] if which == "children" else [])
    assert got.count() == (0 if which == "children" else 1)


def test_tables_together_give_what_they_give_alone(spark):
    a = spark.createDataFrame([(f"r{i}", f"k{i % 7}", None, day(i % 3), None) for i in range(60)], CHILD)
    b = spark.createDataFrame([(f"s{i}", "hot" if i % 3 else f"r{i}", None, day(0), None) for i in range(90)], CHILD)
    p = Parent(spark.createDataFrame([("k1", day(1), "s"), ("k2", day(0), "s")], PARENT), "key", "t", spark.createDataFrame([("k2",)], "k string"))
    q = Parent(a, "id", "t")
    one, two = Child(a, "a", "id", "t", {"fk": p}), Child(b, "b", "id", "t", {"fk": q})
    together = sorted(map(tuple, find_orphans(one, two).collect()))
    assert together == sorted(map(tuple, find_orphans(one).unionByName(find_orphans(two)).collect())) and len(together) > 90
