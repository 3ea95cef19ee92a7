from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeflow.functions import uint256


def total(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "a string").select(uint256.digits("a").alias("d")).select(*uint256.split(F.col("d")))
    r = df.agg(*uint256.sums()).select(uint256.to_text(*[F.col(x) for x in uint256.LIMBS]).alias("t"), uint256.to_double(*[F.col(x) for x in uint256.LIMBS]).alias("d")).first()
    return r.t, r.d


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**256 - 1) | st.integers(0, 10**6), min_size=1, max_size=20))
def test_sums_are_exact(spark, values):
    t, d = total(spark, [str(v) for v in values])
    assert t == str(sum(values)) and d == float(sum(values))


def test_padding_and_no_numbers(spark):
    assert total(spark, [" 0012\t", None, "", "x", "-3", "1.5", "9" * 79, "0" * 90 + "7"])[0] == "19"
    assert total(spark, [None, ""])[0] is None


def test_hex(spark):
    cases = {"0x" + "0" * 63 + "a": "10", "0x" + "f" * 32: str(2**128 - 1), "0X" + "F" * 64: str(2**256 - 1), "0x1" + "0" * 16: str(2**64), "0x": None, "0xzz": None, "12": None, "0x" + "0" * 31 + "1" + "0" * 32: str(2**128), None: None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.v for r in df.select("h", uint256.hex_to_text(F.col("h")).alias("v")).collect()} == cases


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**256 - 1), min_size=2, max_size=12))
def test_hex_and_differences_are_exact(spark, values):
    df = spark.createDataFrame([(f"0x{v:064x}",) for v in values], "h string").select(uint256.hex_to_text(F.col("h")).alias("d"))
    assert sorted(int(r.d) for r in df.collect()) == sorted(values)
    pairs = list(zip(values, values[1:]))
    p = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    minus = [x - y for x, y in zip(uint256.split(F.col("a")), uint256.split(F.col("b")), strict=True)]
    assert [r.t for r in p.select(uint256.to_text(*minus).alias("t")).collect()] == [str(a - b) for a, b in pairs]
    assert [r.t for r in p.select(uint256.at_least(F.col("a"), values[0]).alias("t")).collect()] == [a >= values[0] for a, _ in pairs]
