"""How far detectors agree: overlap of their top shares, rank correlation, agreement of labels."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators.order import average_rank

SHARES = (0.001, 0.005, 0.01)


def _top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The keys of the k highest scores, ties by key."""
    return df.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), key).limit(k).select(key)


def _flags(df: DataFrame, scores: dict[str, str], key: str, k: int) -> DataFrame:
    """key and a 0/1 column per detector for the keys in any top k (at most k times detectors rows)."""
    all_ = None
    for name, c in scores.items():
        t = _top(df, c, key, k).withColumn("_who", F.lit(name))
        all_ = t if all_ is None else all_.unionByName(t)
    return all_.groupBy(key).agg(*[F.max((F.col("_who") == n).cast("int")).alias(n) for n in scores])


def top_overlap(df: DataFrame, scores: dict[str, str], key: str = "address", shares: tuple[float, ...] = SHARES) -> DataFrame:
    """q_percent, k, pair, n_both, n_any, jaccard, overlap: for each share and pair of detectors."""
    n, out = df.dropna(subset=list(scores.values())).count(), None
    rows = df.dropna(subset=list(scores.values()))
    for q in shares:
        k = max(1, round(n * q))
        f = _flags(rows, scores, key, k)
        for a, b in combinations(scores, 2):
            one = f.agg(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias("n_both"), F.coalesce(F.sum(F.greatest(a, b)), F.lit(0)).cast("bigint").alias("n_any"))
            one = one.select(F.lit(q * 100).alias("q_percent"), F.lit(k).alias("k"), F.lit(f"{a} vs {b}").alias("pair"), "n_both", "n_any", F.when(F.col("n_any") > 0, F.col("n_both") / F.col("n_any")).otherwise(0.0).alias("jaccard"), (F.col("n_both") / F.lit(k)).alias("overlap"))
            out = one if out is None else out.unionByName(one)
    return out


def common_top(df: DataFrame, scores: dict[str, str], key: str = "address", shares: tuple[float, ...] = SHARES) -> DataFrame:
    """q_percent, k, n_all: the keys that are in every detector's top share."""
    rows, out = df.dropna(subset=list(scores.values())), None
    n = rows.count()
    for q in shares:
        k = max(1, round(n * q))
        product = F.lit(1)
        for s in scores:
            product = product * F.col(s)
        one = _flags(rows, scores, key, k).agg(F.coalesce(F.sum(product), F.lit(0)).cast("bigint").alias("n_all")).select(F.lit(q * 100).alias("q_percent"), F.lit(k).alias("k"), "n_all")
        out = one if out is None else out.unionByName(one)
    return out


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_test_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation r of n pairs by Student's t."""
    if n < 3 or r is None or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return _beta_tail(df / (df + r * r * df / (1 - r * r)), df / 2, 0.5)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho, p_value, n of two columns over the rows that have both."""
    rows = df.select(a, b).dropna()
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    r = ranked.agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n")).first()
    return df.sparkSession.createDataFrame([(r.rho, t_test_p(r.rho, r.n), r.n)], "rho double, p_value double, n bigint")


def kappa(df: DataFrame, a: str, b: str, share: float = 0.01) -> DataFrame:
    """Cohen's kappa of "in the top share" by two columns (at or above the quantile), with the four counts."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    q = rows.agg(F.percentile("a", F.lit(1 - share)).alias("qa"), F.percentile("b", F.lit(1 - share)).alias("qb")).first()
    x, y = (F.col(c) >= F.lit(v) if v is not None else F.lit(False) for c, v in (("a", q.qa), ("b", q.qb)))
    c = rows.agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    agree = (F.col("n11") + F.col("n00")) / n
    chance = ((F.col("n11") + F.col("n10")) / n) * ((F.col("n11") + F.col("n01")) / n) + ((F.col("n01") + F.col("n00")) / n) * ((F.col("n10") + F.col("n00")) / n)
    return c.where(n > 0).select("n11", "n10", "n01", "n00", F.when(chance < 1, (agree - chance) / (1 - chance)).alias("kappa"))


def diagnostics(df: DataFrame, column: str, key: str = "address", k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The distribution of a column (count, mean, deviation, extremes, quartiles), and its k highest rows, ties by key."""
    return df.select(column).summary(), df.select(key, column).where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), key).limit(k)
