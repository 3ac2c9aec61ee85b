"""Correlation, composite screens, regression lines and distribution statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import numeric_columns, safe_div
from assaylake.functions.distributions import normal_quantile, pearson_p, pearson_p_of
from assaylake.operators.gram import Gram, gram, matrix_frame
from assaylake.operators.quantiles import exact_quantiles

COMBINATION_LIMIT = 5000  # fixed value: more combinations are refused, not cut
CORRELATION_ROWS = 300  # fixed value: default length of the ranked list


def target_correlations(
    df: DataFrame, target: str, features: Sequence[str] | None = None, top: int = CORRELATION_ROWS
) -> DataFrame:
    """Pearson r and p per feature over the rows complete in the pair, by |r|."""
    features = [c for c in features or numeric_columns(df) if c != target]
    y = F.col(target).cast("double")
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.regr_count(y, x).alias(f"n{i}"), F.regr_sxx(y, x).alias(f"sxx{i}"),
                 F.regr_syy(y, x).alias(f"syy{i}"), F.regr_sxy(y, x).alias(f"sxy{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(features):
        n, sxx, syy, sxy = (row[f"{k}{i}"] for k in ("n", "sxx", "syy", "sxy"))
        if n < 3 or not sxx or not syy:
            continue
        r = max(-1.0, min(1.0, sxy / math.sqrt(sxx * syy)))
        out.append((c, float(r), abs(float(r)), pearson_p(r, n), int(n)))
    out = sorted(out, key=lambda t: -t[2])[:top]
    return df.sparkSession.createDataFrame(
        out, "feature string, correlation double, abs_correlation double, p_value double, n long"
    )


def correlation_by_group(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, correlation, p_value) per group over the rows complete in the pair; groups of fewer than three rows or a constant side have none."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    m = df.groupBy(*by).agg(F.regr_count(a, b).alias("n"), F.regr_sxx(a, b).alias("sxx"), F.regr_syy(a, b).alias("syy"), F.regr_sxy(a, b).alias("sxy"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))))
    m = m.withColumn("correlation", F.when((F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0), r))
    return m.select(*by, "n", "correlation", F.when(F.col("correlation").isNotNull(), pearson_p_of(F.col("correlation"), F.col("n"))).alias("p_value"))


def pairwise_correlation(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Correlation matrix where each pair uses the rows complete in that pair.

    Values, squares and presence marks go through one Gram pass; its blocks hold
    the per-pair counts, sums, squares and products.
    """
    cols = list(cols)
    p = len(cols)
    head = df.select(*cols).limit(1000).agg(*[F.avg(c).alias(c) for c in cols]).first()
    x = [F.col(c).cast("double") - F.lit(head[c] or 0.0) for c in cols]
    wide = df.select(
        *[F.coalesce(v, F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(x)],
        *[F.coalesce(v * v, F.lit(0.0)).alias(f"q{i}") for i, v in enumerate(x)],
        *[F.col(c).isNotNull().cast("double").alias(f"m{i}") for i, c in enumerate(cols)],
    )
    g = gram(wide, wide.columns)
    s = g.cross + g.n * np.outer(g.mean, g.mean)
    v, q, m = slice(0, p), slice(p, 2 * p), slice(2 * p, 3 * p)
    n, sx, sxx, sxy = s[m, m], s[v, m], s[q, m], s[v, v]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sx.T / n
        var = sxx - sx * sx / n
        var = np.where(var > 1e-12 * np.maximum(sxx, 1e-300), var, np.nan)
        r = cov / np.sqrt(var * var.T)
    return np.clip(r, -1.0, 1.0)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, absolute: bool = True) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    r = pairwise_correlation(df, cols)
    return matrix_frame(df.sparkSession, cols, np.abs(r) if absolute else r, "r")


def correlation_strength(df: DataFrame, cols: Sequence[str] | None = None, top: int = 8) -> DataFrame:
    """Sum of |r| with the other columns, strongest columns first."""
    m = correlation_matrix(df, cols)
    return (
        m.groupBy(F.col("row").alias("column"))
        .agg((F.sum("r") - 1.0).alias("strength"))
        .orderBy(F.desc("strength"), "column")
        .limit(top)
    )


def composite_correlations(
    df: DataFrame, target: str, features: Sequence[str], size: int = 2, pool: int = 25, top: int = 50
) -> DataFrame:
    """Mean of z-scores of every feature combination against the target.

    For complete rows r(composite, y) = sum(r_iy) / sqrt(sum(r_ij)), so one Gram
    pass serves all combinations. Rows with a null in the pool are left out.
    """
    g = gram(df, [*features, target])
    r = g.correlation()
    ry = {c: r[i, -1] for i, c in enumerate(features)}
    pooled = sorted((c for c in features if not np.isnan(ry[c])), key=lambda c: -abs(ry[c]))[:pool]
    if math.comb(len(pooled), size) > COMBINATION_LIMIT:
        raise ValueError(f"more than {COMBINATION_LIMIT} combinations: reduce the pool or the size")
    at = {c: i for i, c in enumerate(features)}
    rows = []
    for combo in combinations(pooled, size):
        idx = [at[c] for c in combo]
        spread = r[np.ix_(idx, idx)].sum()
        if spread <= 1e-12:
            continue
        v = float(np.clip(sum(ry[c] for c in combo) / math.sqrt(spread), -1, 1))
        rows.append((" + ".join(combo), v, abs(v), pearson_p(v, g.n), g.n))
    rows = sorted(rows, key=lambda t: -t[2])[:top]
    return df.sparkSession.createDataFrame(
        rows, "label string, correlation double, abs_correlation double, p_value double, n long"
    )


def group_correlations(
    df: DataFrame, target: str, groups: Mapping[str, Sequence[str]], size: int = 2
) -> DataFrame:
    """Mean and largest |r| with the target, and R2 of a joint fit, per group combination.

    One Gram pass over the data; the combinations are then solved in parallel as
    sub-matrices of it.
    """
    if math.comb(len(groups), size) > COMBINATION_LIMIT:
        raise ValueError(f"more than {COMBINATION_LIMIT} combinations: reduce the size")
    cols = list(dict.fromkeys(c for members in groups.values() for c in members if c in df.columns))
    g = gram(df, [*cols, target])
    spark = df.sparkSession
    combos = spark.createDataFrame([(list(c),) for c in combinations(groups, size)], "group_ids array<string>")
    members = {k: [c for c in v if c in cols] for k, v in groups.items()}
    r = np.abs(g.correlation()[:-1, -1])

    def solve(batches):
        for pdf in batches:
            out = []
            for ids in pdf["group_ids"]:
                idx = [cols.index(c) for k in ids for c in members[k]]
                if not idx or np.isnan(r[idx]).all():
                    continue
                u = list(dict.fromkeys(idx))
                b = np.linalg.lstsq(g.cross[np.ix_(u, u)], g.cross[u, -1], rcond=None)[0]
                r2 = float(b @ g.cross[u, -1] / g.cross[-1, -1])
                out.append((" + ".join(ids), len(idx), float(np.nanmean(r[idx])), float(np.nanmax(r[idx])), r2))
            yield pd.DataFrame(out, columns=["groups", "n_descriptors", "avg_correlation", "max_correlation", "r2_score"])

    return combos.repartition(max(1, min(64, len(groups)))).mapInPandas(
        solve, "groups string, n_descriptors int, avg_correlation double, max_correlation double, r2_score double"
    )


def regression_line(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    grouped = df.groupBy(by) if by else df
    return grouped.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
    )


def _moments(c: Column) -> list[Column]:
    return [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
        F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
    ]


def k_squared(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino's K2 from the moments: z of the skewness squared plus z of the kurtosis squared."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27.0 * n - 70.0) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (b2 - 1.0)) - 1.0
    alpha = F.sqrt(2.0 / (w2 - 1.0))
    z1 = 1.0 / F.sqrt(0.5 * F.ln(w2)) * F.ln(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1.0))
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3.0 - mean) / F.sqrt(var)
    g = 6.0 * (n * n - 5.0 * n + 2.0) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / g * (2.0 / g + F.sqrt(1.0 + 4.0 / (g * g)))
    z2 = (1.0 - 2.0 / (9.0 * a) - F.cbrt((1.0 - 2.0 / a) / (1.0 + x * F.sqrt(2.0 / (a - 4.0))))) / F.sqrt(2.0 / (9.0 * a))
    return z1 * z1 + z2 * z2


def distribution_stats(df: DataFrame, col: str) -> DataFrame:
    """n, mean, median, population std, skewness, excess kurtosis, K2 and its p-value."""
    c = F.col(col).cast("double")
    median = exact_quantiles(df, [col], [0.5])[col][0]
    m = df.agg(*_moments(c)).withColumn("median", F.lit(median).cast("double"))
    k2 = F.when((F.col("n") >= 20) & F.col("skewness").isNotNull(), k_squared(F.col("n"), F.col("skewness"), F.col("kurtosis")))
    return m.withColumn("k2", k2).withColumn("normality_p", F.exp(-F.col("k2") / 2.0))


def qq_points(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Ordered sample quantiles against normal quantiles, at fixed probabilities."""
    probs = [(i + 0.5) / points for i in range(points)]
    q = exact_quantiles(df, [col], probs)[col]
    return df.sparkSession.createDataFrame(
        [(p, normal_quantile(p), float(v)) for p, v in zip(probs, q)], "prob double, theoretical double, sample double"
    )


def vif(g: Gram, features: Sequence[str]) -> dict[str, float]:
    """Variance inflation: diagonal of the inverse correlation matrix."""
    r = g.select(features).correlation()
    if len(features) == 1:
        return {features[0]: 1.0}
    return dict(zip(features, map(float, np.diag(np.linalg.pinv(r, hermitian=True)))))


def concordance(y: Column, yhat: Column, sample: bool = False) -> Column:
    """Lin's concordance in its population or sample form, as an aggregate."""
    cov = F.covar_samp(y, yhat) if sample else F.covar_pop(y, yhat)
    var = F.var_samp if sample else F.var_pop
    d = F.avg(y) - F.avg(yhat)
    return safe_div(2.0 * cov, var(y) + var(yhat) + d * d)
