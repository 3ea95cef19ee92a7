import datetime
import random

from lodeflow.functions import uint256
from lodeflow.operators.rolling import trailing_totals

EPOCH = datetime.date(1970, 1, 1)


def daily(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(e, d, n, str(a)) for e, d, n, a in rows], "who string, day_no int, n bigint, a string")
    return df.select("who", "day_no", "n", *uint256.split(F.col("a")), F.lit(1).alias("_next"))


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(w, d, rng.randrange(1, 4), rng.randrange(2**200)) for w in ("a", "b", "c") for d in sorted(rng.sample(range(100, 160), rng.randrange(1, 30)))]
    got = trailing_totals(daily(spark, rows), "who", (7, 30), 95, 170).collect()
    assert len(got) == 3 * 76 and len({(r.who, r.day) for r in got}) == len(got)
    for r in got:
        d = (r.day - EPOCH).days
        for p in (7, 30):
            inside = [(n, a) for w, x, n, a in rows if w == r.who and d - p < x <= d]
            assert r[f"n_{p}d"] == sum(n for n, _ in inside)
            assert r[f"total_{p}d"] == str(sum(a for _, a in inside))
            assert r[f"avg_{p}d"] == float(sum(a for _, a in inside)) / p


def test_empty_null_and_outside(spark):
    assert trailing_totals(daily(spark, []), "who", (7,), 0, 9).count() == 0
    assert trailing_totals(daily(spark, [(None, 3, 1, 5), ("a", 99, 1, 5)]), "who", (7,), 0, 9).count() == 0
    one = trailing_totals(daily(spark, [("a", 9, 1, 5)]), "who", (7,), 0, 9).orderBy("day").collect()
    assert [r.total_7d for r in one] == ["0"] * 9 + ["5"]
