"""Percentile scores and the analysis result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators import detect
from lodeflow.operators.forest import SAMPLE, TREES, isolation_scores
from lodeflow.operators.order import average_rank
from lodeflow.schemas import RESULT_COLUMNS, RULES
from lodeflow.session import stored

PARTS = ("rule_score_100", "mahalanobis_distance_stats_score_100", "iforest_stats_score_100")


def hazen(df: DataFrame, value: str, score: str) -> DataFrame:
    """df with 100 * (average rank - 0.5) / rows, as float; rows without a value count in the number of rows only."""
    n = df.count()
    return average_rank(df, value, "_rank").withColumn(score, ((F.col("_rank") - 0.5) / F.lit(max(n, 1)) * 100).cast("float")).drop("_rank")


def rule_score(df: DataFrame) -> DataFrame:
    raw = F.greatest(*[F.col(f"{r}_flag") for r in RULES[:4]]) + F.col("H5_flag") + F.col("H6_flag")
    return df.withColumn("rule_score_raw", raw).withColumn("rule_score_100", F.bround(F.col("rule_score_raw") * 100 / F.lit(3.0), 2).cast("float"))


def final_score(df: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """The mean of the scores that exist, as float, its rank from the top in percent, and that as text."""
    known = sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
    scored = df.withColumn("final_score_0_100", F.when(known > 0, total / known).cast("float"))
    n = max(df.count(), 1)
    ranked = average_rank(scored, "final_score_0_100", "_rank", descending=True)
    percent = F.bround(F.col("_rank") / F.lit(n) * 100, 2)
    return ranked.withColumn("final_score_top_percent", percent.cast("float")).withColumn("final_score_top_percent_display", F.format_string("%.2f%%", percent)).drop("_rank")


def statistics(plain: DataFrame) -> DataFrame:
    """The rows (no infrastructure) with logs, z-scores and the Mahalanobis distance."""
    logged = detect.with_logs(plain)
    m = detect.moments(logged, detect.TRANSFORMED)
    return detect.with_mahalanobis(detect.with_z(logged, m), m)


def usable_scores(stats: DataFrame) -> list[str]:
    """The z-scores that exist, those of columns that vary."""
    n = stats.agg(*[F.count(c).alias(c) for c in detect.Z_SCORES]).first()
    return [c for c in detect.Z_SCORES if n[c]]


def result_table(features: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The 44 columns of the analysis result for every vertex; infrastructure accounts have NULL from the flags on."""
    plain = detect.coerce(features.where("is_infra = 0"), ("in_degree", "out_degree", "two_node_loop_count", "triangle_loop_count", "egonet_density"))
    stats = stored(statistics(detect.with_rules(plain)), "stats")
    usable = usable_scores(stats)
    forest = isolation_scores(stats, "node", usable, trees=trees, sample=sample)
    scored = rule_score(stats.join(forest, "node"))
    scored = hazen(hazen(stored(scored), "mahalanobis_distance", PARTS[1]), "iforest_score", PARTS[2])
    scored = final_score(stored(scored))
    types = dict(features.dtypes)
    keep = [F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in RESULT_COLUMNS]
    infra = features.where("is_infra <> 0")
    return scored.select(*keep).unionByName(infra, allowMissingColumns=True).select(*RESULT_COLUMNS)
