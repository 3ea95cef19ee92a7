"""Rule-based and statistical detectors over the feature table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.schemas import RULE_TEXTS

#: Columns with a threshold; those of loops take rows above zero only.
THRESHOLDS = ("in_degree", "out_degree", "two_node_loop_amount", "two_node_loop_tx_count", "triangle_loop_amount", "triangle_loop_tx_count")
NUMERIC = ("in_degree", "out_degree", "total_input_amount", "total_output_amount", "two_node_loop_count", "triangle_loop_count", "egonet_density", "self_loop_count")
LOGGED = ("in_degree", "out_degree", "total_input_amount", "total_output_amount", "two_node_loop_count", "triangle_loop_count")
TRANSFORMED = (*[f"{c}_log" for c in LOGGED], "log_degree_ratio", "log_amount_ratio", "egonet_density")
Z_SCORES = tuple(f"{c}_z" for c in TRANSFORMED)
MAX_OUT, RATIO = 3, 0.05


def coerce(df: DataFrame, columns: tuple[str, ...] = NUMERIC) -> DataFrame:
    """The columns that exist as double, 0 where they are no number."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns if c in df.columns})


def thresholds(df: DataFrame, quantile: float = 0.99) -> DataFrame:
    """One row: the exact interpolated quantile of each threshold column; NULL where no row counts."""
    value = lambda c: F.col(c) if c in ("in_degree", "out_degree") else F.when(F.col(c) > 0, F.col(c))
    return df.agg(*[F.percentile(value(c).cast("double"), F.lit(quantile)).alias(c) for c in THRESHOLDS])


def with_rules(df: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """df with H1 to H6: flag (0 or 1) and description. A missing threshold lets no rule fire."""
    q = (thresholds(df) if limits is None else limits).first().asDict()

    def top(c: str) -> Column:
        return F.lit(False) if q[c] is None else F.col(c) >= F.lit(q[c])

    i, o, a, b = F.col("in_degree"), F.col("out_degree"), F.col("total_input_amount").cast("double"), F.col("total_output_amount").cast("double")
    even = F.when(a > 0, F.abs(a - b) / a) <= RATIO
    rules = {
        "H1": top("in_degree") & (o <= MAX_OUT) & even,
        "H2": top("in_degree") & (o == 0),
        "H3": (i == 1) & top("out_degree"),
        "H4": top("in_degree") & top("out_degree") & even,
        "H5": (F.col("two_node_loop_count") >= 1) & (top("two_node_loop_amount") | top("two_node_loop_tx_count")),
        "H6": (F.col("triangle_loop_count") >= 1) & (top("triangle_loop_amount") | top("triangle_loop_tx_count")),
    }
    flags = {f"{r}_flag": F.coalesce(c, F.lit(False)).cast("int") for r, c in rules.items()}
    return df.withColumns(flags).withColumns({f"{r}_description": F.when(F.col(f"{r}_flag") == 1, F.lit(t)).otherwise("") for r, t in RULE_TEXTS.items()})


def rule_totals(df: DataFrame) -> DataFrame:
    return df.agg(*[F.sum(f"{r}_flag").cast("bigint").alias(f"{r}_flag") for r in RULE_TEXTS])


def with_logs(df: DataFrame) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    logs = {f"{c}_log": F.log1p(d(c)) for c in LOGGED}
    ratio = lambda x, y: F.log((d(x) + 1) / (d(y) + 1))
    return df.withColumns(logs | {"log_degree_ratio": ratio("in_degree", "out_degree"), "log_amount_ratio": ratio("total_input_amount", "total_output_amount")})


@dataclass
class Moments:
    """Mean, sample standard deviation and covariance of columns, from one aggregation."""

    columns: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    covariance: np.ndarray

    @property
    def varying(self) -> list[int]:
        return [i for i, s in enumerate(self.std) if np.isfinite(s) and s > 1e-12]


def moments(df: DataFrame, columns: tuple[str, ...]) -> Moments:
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    n = len(columns)
    get = lambda x: np.nan if x is None else float(x)
    cov = np.zeros((n, n))
    for k, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = get(r[n + k])
    return Moments(columns, np.array([get(x) for x in r[:n]]), np.sqrt(np.clip(np.diag(cov), 0, None)), cov)


def with_z(df: DataFrame, m: Moments) -> DataFrame:
    """Columns <name>_z; NULL where a column doesn't vary."""
    ok = set(m.varying)
    z = lambda i, c: (F.col(c) - F.lit(float(m.mean[i]))) / F.lit(float(m.std[i])) if i in ok else F.lit(None).cast("double")
    return df.withColumns({f"{c}_z": z(i, c) for i, c in enumerate(m.columns)})


def with_mahalanobis(df: DataFrame, m: Moments, name: str = "mahalanobis_distance", cutoff: float = 1e-10) -> DataFrame:
    """Distance of the z-scores by the pseudo-inverse of their covariance; 0 if no column varies, NULL for rows with a NULL.

    Two of the inputs are sums of others, so the covariance has no inverse; the
    pseudo-inverse (relative cutoff of singular values) is the defined distance.
    """
    v = m.varying
    if not v:
        return df.withColumn(name, F.lit(0.0))
    corr = m.covariance[np.ix_(v, v)] / np.outer(m.std[v], m.std[v])
    p = np.linalg.pinv(corr, rcond=cutoff, hermitian=True)
    z = [F.col(f"{m.columns[i]}_z") for i in v]
    total = F.lit(0.0)
    for a in range(len(v)):
        for b in range(a, len(v)):
            w = float(p[a, b]) * (1 if a == b else 2)
            total = total + F.lit(w) * z[a] * z[b]
    return df.withColumn(name, F.sqrt(F.greatest(total, F.when(total.isNotNull(), F.lit(0.0)))))
