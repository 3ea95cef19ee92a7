"""Totals over trailing periods of days, for every entity and calendar day.

Range frames over integer day numbers run on sparse rows only: a trailing
total changes on a day with activity or on the day that activity leaves the
period. Those change points carry the frames; the calendar rows between two
change points take the values of the first. The cost of the frames therefore
follows the activity, not entities times days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions import uint256


def trailing_totals(daily: DataFrame, entity: str, periods: tuple[int, ...], first_day: int, last_day: int) -> DataFrame:
    """entity, day, and for each period p: n_p (bigint), total_p (exact digit text), avg_p (total over p days, double).

    daily: entity, day_no (int), n and the three uint256 limbs, one row per
    entity and active day. Days run from first_day to last_day; every entity
    gets each of them, zeros before its first activity. The denominator of an
    average is the period's length, also at the start of the data. Entities
    that are NULL are left out; an empty frame gives an empty result.
    """
    zero = [F.lit(0).cast("decimal(38,0)").alias(x) for x in uint256.LIMBS]
    state = ["n", *uint256.LIMBS]
    active = daily.where(F.col(entity).isNotNull() & F.col("day_no").between(first_day, last_day))
    point = lambda day, *cols: F.struct(day.cast("int").alias("day_no"), *cols)
    none = [F.lit(0).cast("bigint").alias("n"), *zero]
    points = active.select(
        entity,
        F.explode(
            F.array(
                point(F.col("day_no"), F.col("n").cast("bigint").alias("n"), *[F.col(x).cast("decimal(38,0)").alias(x) for x in uint256.LIMBS]),
                point(F.lit(first_day), *none),
                *[point(F.col("day_no") + p, *none) for p in periods],
            )
        ).alias("_p"),
    ).select(entity, "_p.*").where(F.col("day_no") <= last_day)
    # One row per change point, before the windows: hot entities shrink to a row a day.
    points = points.groupBy(entity, "day_no").agg(F.sum("n").alias("n"), *uint256.sums())
    by_day = Window.partitionBy(entity).orderBy("day_no")
    framed = points
    for p in periods:
        w = by_day.rangeBetween(-(p - 1), 0)
        framed = framed.select("*", *[F.sum(x).over(w).cast("bigint" if x == "n" else "decimal(38,0)").alias(f"{x}_{p}") for x in state])
    framed = framed.withColumn("_next", F.coalesce(F.lead("day_no").over(by_day), F.lit(last_day + 1)))
    out = []
    for p in periods:
        text = uint256.to_text(*[F.col(f"{x}_{p}") for x in uint256.LIMBS])
        out += [F.col(f"n_{p}").alias(f"n_{p}d"), text.alias(f"total_{p}d"), (text.cast("double") / F.lit(float(p))).alias(f"avg_{p}d")]
    filled = framed.select(entity, F.expr("sequence(day_no, _next - 1)").alias("_days"), *out)
    cols = [c for p in periods for c in (f"n_{p}d", f"total_{p}d", f"avg_{p}d")]
    return filled.select(entity, F.explode("_days").alias("_day"), *cols).select(entity, F.date_from_unix_date("_day").alias("day"), *cols)
