from pyspark.sql import functions as F

from lodeflow.functions.compact import compact, restore

H = "ab" * 32
CASES = [f"1_0x{H}", f"1_0x{H}_0", f"137_0x{H}_12", f"1_0x{H[:40]}", f"01_0x{H}", f"1_0x{H}_007", "1_native", "", "_", f"1_0x{H[:39]}", f"1_0x{H.upper()}", "1_0x", f"x1_0x{H}", f"1_0x{H}_", "ü_0x", "1_21004121", None, "a" * 5000]


def test_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string").select("s", compact(F.col("s")).alias("b"))
    rows = df.select("s", restore(F.col("b")).alias("r"), "b").collect()
    assert all(r.s == r.r for r in rows)
    kept = [bytes(r.b) for r in rows if r.b is not None]
    assert len(set(kept)) == len(CASES) - 1 and sum(r.b is None for r in rows) == 1
