import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeflow.streaming.exactly_once import _Expired, deduplicate

SCHEMA = "id string, t bigint, n bigint, v string, _kind string"
DAY = 86400


def run(spark, tmp_path, files, delay=DAY, folder=None, shards=4):
    src = tmp_path / "in"
    src.mkdir(exist_ok=True)
    for name, rows in files:
        p = str(src / name)
        spark.createDataFrame([(i, t, n, v, "x") for i, t, n, v in rows], SCHEMA).coalesce(1).write.mode("overwrite").parquet(p)
        for f in os.listdir(p):  # the files' times give the order of the batches
            if f.endswith(".parquet"):
                os.rename(f"{p}/{f}", f"{src}/{name}.parquet")
                k = int(name[1:])
                os.utime(f"{src}/{name}.parquet", (1e9 + k, 1e9 + k))
        os.system(f"rm -rf {p}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*.parquet").withColumn("at", F.timestamp_seconds("t"))
    return deduplicate(stream, F.col("id"), "at", "n", ["n", "v"], folder or str(tmp_path / "out"), delay, shards)


def check(result, rows):
    n = Counter(i for i, *_ in rows if i is not None)
    kept = result.rows.collect()
    assert sorted(r._key for r in kept) == sorted(n)
    assert sorted(r._key for r in result.repeated.collect()) == sorted(k for k, c in n.items() if c > 1)
    return {r._key: r for r in kept}


def test_copies_within_and_across_batches(spark, tmp_path):
    a = [("x", 10, 2, "second"), ("x", 10, 1, "first"), ("y", 5, 3, "y"), (None, 5, 4, "none"), ("", 6, 5, "blank")]
    b = [("y", 20, 6, "again"), ("z", 21, 7, None)] + [("hot", 22, 10 + i, "h") for i in range(300)]
    kept = check(run(spark, tmp_path, [("f1", a), ("f2", b)]), a + b)
    assert kept["x"].v == "first" and kept["y"].v == "y" and kept["hot"].n == 10


def test_copies_after_expiry_are_looked_up(spark, tmp_path):
    a = [(f"k{i}", i, i, "old") for i in range(40)]
    b = [(f"m{i}", 10 * DAY + i, 100 + i, "new") for i in range(40)]
    late = [("k3", 10 * DAY + 50, 200, "copy long after"), ("k4", 4, 201, "late copy"), ("w", 5, 202, "late but new"), ("m1", 10 * DAY + 60, 203, "copy")]
    kept = check(run(spark, tmp_path, [("f1", a), ("f2", b), ("f3", late)]), a + b + late)
    assert kept["k3"].v == "old" and kept["w"].v == "late but new"


def test_goes_on_where_it_ended(spark, tmp_path):
    a, b = [("x", 1, 1, "a")], [("x", 2, 2, "b"), ("y", 2, 3, "c")]
    check(run(spark, tmp_path, [("f1", a)]), a)
    check(run(spark, tmp_path, [("f2", b)]), a + b)
    check(run(spark, tmp_path, []), a + b)


def test_null_times_and_ties(spark, tmp_path):
    a = [("x", None, 2, "b"), ("x", None, 1, "a"), ("y", None, None, "c"), ("y", 3, None, "d"), ("z", 3, 5, "z")]
    b = [("z", None, 6, "z again"), ("u", None, 7, "u"), ("x", 90, 8, "x again")]
    kept = check(run(spark, tmp_path, [("f1", a), ("f2", b)]), a + b)
    # A row without a time comes after one that has a time, and counts as the newest.
    assert kept["x"].v == "a" and kept["y"].v == "d" and kept["z"].v == "z"


@pytest.mark.parametrize("shards", [1, 16])
def test_same_result_for_any_number_of_shards(spark, tmp_path, shards):
    rows = [(f"i{k % 50}", k, k, str(k)) for k in range(200)]
    kept = check(run(spark, tmp_path, [("f1", rows[:120]), ("f2", rows[120:])], shards=shards), rows)
    assert {k: r.n for k, r in kept.items()} == {f"i{k}": k for k in range(50)}


def test_filters_forget_nothing_and_name_the_period():
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**62), 2**62, size=(2, 30_000))
    period = np.repeat(np.arange(30), 1000)
    e = _Expired()
    for i in range(0, 30_000, 5000):
        e.add(*h[:, i : i + 5000], period[i : i + 5000])
    e = _Expired(*e.packed())
    low, high = e.periods(*h)
    assert ((low <= period) & (period <= high)).all() and len(e.filters) == 4
    assert np.median(high - low) < 12
    low, high = e.periods(*rng.integers(-(2**62), 2**62, size=(2, 20_000)))
    assert (low <= high).mean() < 0.02


def test_only_late_rows_are_looked_up_and_only_in_their_period(spark, tmp_path):
    """Batches ten delays apart: everything expires each time, new identifiers are still accepted without a look-up."""
    files = [(f"f{b}", [(f"b{b}k{i}", b * 10 * DAY + i, b * 1000 + i, "v") for i in range(60)]) for b in range(1, 6)]
    files[4][1].append(("b1k7", 50 * DAY + 70, 9999, "late"))
    r = run(spark, tmp_path, files)
    check(r, [x for _, rows in files for x in rows])
    looked = r._events().where("_kind = 1").collect()
    assert "b1k7" in {x._key for x in looked} and len(looked) <= 2
    late = next(x for x in looked if x._key == "b1k7")
    assert late._from <= 10 <= late._to and late._to < 50
