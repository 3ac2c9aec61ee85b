"""p-values and quantiles without an external statistics package.

The plain functions serve one value per column or model; the column expressions
(``*_of``) serve one value per row or group, inside Spark.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_upper(f: float, d1: float, d2: float) -> float:
    if not (d1 > 0 and d2 > 0) or math.isnan(f):
        return math.nan
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def pearson_p(r: float | None, n: int) -> float | None:
    if r is None or n < 3:
        return None
    if n == 2 or abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# ------------------------------------------------------------------ column expressions

TERMS = 300  # steps of the continued fraction; it needs about the square root of the larger parameter


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive values: Stirling's series eight places further up."""
    up = x + 8.0
    series = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi)
    for power, divisor in ((1, 12.0), (3, -360.0), (5, 1260.0), (7, -1680.0), (9, 1188.0), (11, -360360.0 / 691)):
        series = series + 1.0 / (divisor * up**power)
    for k in range(8):
        series = series - np.log(x + float(k))
    return series


def _fraction(p: np.ndarray, q: np.ndarray, z: np.ndarray, terms: int) -> np.ndarray:
    """The continued fraction of all rows of a batch; a row leaves when it has converged."""
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    out = np.empty(len(z))
    at, c, d = np.arange(len(z)), np.ones(len(z)), 1.0 / safe(1.0 - (p + q) * z / (p + 1.0))
    f = d.copy()
    for m in range(1, terms + 1):
        for num in (m * (q - m) * z / ((p + 2.0 * m - 1.0) * (p + 2.0 * m)), -(p + m) * (p + q + m) * z / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))):
            d, c = 1.0 / safe(1.0 + num * d), safe(1.0 + num / c)
            f = f * c * d
        done = np.abs(c * d - 1.0) < 1e-15
        if done.any():
            out[at[done]] = f[done]
            at, p, q, z, c, d, f = (v[~done] for v in (at, p, q, z, c, d, f))
        if not len(at):
            break
    out[at] = f
    return out


def beta_inc_of(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised incomplete beta function by its continued fraction, over Arrow batches that end when all their rows have converged."""

    @F.pandas_udf("double")
    def inside(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        a, b, x = (v.to_numpy(float, na_value=np.nan) for v in (a, b, x))
        value = np.full(len(x), np.nan)
        with np.errstate(all="ignore"):
            rows = np.flatnonzero((x > 0) & (x < 1) & ~np.isnan(a) & ~np.isnan(b))
            a, b, x = a[rows], b[rows], x[rows]
            turned = x > (a + 1.0) / (a + b + 2.0)  # the fraction converges fast below this place
            p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1.0 - x, x)
            front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
            v = np.where(z <= 0, 0.0, front * _fraction(p, q, z, terms))
            value[rows] = np.where(turned, 1.0 - v, v)
        return pd.Series(value)

    a, b, x = (c.cast("double") for c in (a, b, x))
    known = a.isNotNull() & b.isNotNull() & x.isNotNull()
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(known, F.coalesce(inside(a, b, x), F.lit(math.nan)))


def t_two_sided_of(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null where there are no degrees of freedom."""
    df = df.cast("double")
    return F.when(df > 0, beta_inc_of(df / 2.0, F.lit(0.5), df / (df + t * t)))


def f_upper_of(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    return F.when((d1 > 0) & (d2 > 0), F.when(f <= 0, 1.0).otherwise(beta_inc_of(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))))


def pearson_p_of(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation; null below three rows, 0 for a perfect one."""
    df = n.cast("double") - 2.0
    left = 1.0 - r * r
    return F.when(n >= 3, F.when(left <= 0, 0.0).otherwise(beta_inc_of(df / 2.0, F.lit(0.5), left)))
