"""Least squares from cross-products, with validation and applicability domain.

Fitting, k-fold validation and collinearity need one pass for the (per-fold)
Gram; leave-one-out and leverage need one scoring pass with the p x p inverse
inlined as an expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.columns import first_true, safe_div, sum_columns
from assaylake.functions.distributions import f_upper, t_two_sided
from assaylake.operators.gram import Gram, gram, gram_by
from assaylake.operators.split import kfold

RESIDUAL_LIMIT = 3.0  # fixed value: |standardised residual| of an outlier
EXPRESSION_LIMIT = 16  # features up to which leverage is one plain expression


@dataclass
class LinearModel:
    """A fitted model as data: everything here is sized by the features."""

    target: str
    features: list[str]
    intercept: bool
    const: float
    coef: np.ndarray
    n: int
    sse: float
    tss: float
    mean_x: np.ndarray
    mean_y: float
    inverse: np.ndarray  # inverse of the (centred, if intercept) cross-product matrix

    @property
    def columns_in_design(self) -> int:
        return len(self.features) + int(self.intercept)

    @property
    def sigma2(self) -> float:
        return self.sse / max(self.n - self.columns_in_design, 1)

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.tss if self.tss else float("nan")

    @property
    def h_star(self) -> float:
        return 3.0 * (len(self.features) + 1) / self.n

    def predict(self) -> Column:
        """Score expression."""
        return linear_formula(dict(zip(self.features, map(float, self.coef))), self.const)

    def leverage(self, with_intercept: bool = True) -> Column:
        """h = x' (X'X)^-1 x as an expression, or an Arrow batch function for wide models."""
        centre = self.mean_x if self.intercept and with_intercept else np.zeros(len(self.features))
        base = 1.0 / self.n if self.intercept and with_intercept else 0.0
        inv = self.inverse
        if self.intercept and not with_intercept:
            raise ValueError("fit without an intercept for leverage without one")
        if len(self.features) <= EXPRESSION_LIMIT:
            d = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(self.features, centre)]
            terms = [
                d[i] * d[j] * F.lit(float(inv[i, j] * (1 if i == j else 2)))
                for i in range(len(d)) for j in range(i, len(d))
            ]
            return F.lit(base) + sum_columns(terms)
        root = np.linalg.cholesky(inv + 1e-15 * np.trace(inv) * np.eye(len(inv)))

        @F.pandas_udf("double")
        def rows(x: pd.Series) -> pd.Series:
            z = (np.stack(x.to_numpy()) - centre) @ root
            return pd.Series(base + (z * z).sum(axis=1))

        return rows(F.array(*[F.col(c).cast("double") for c in self.features]))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Coefficient, standard error, t and p per term."""
        df = self.n - self.columns_in_design
        se = np.sqrt(np.maximum(self.sigma2 * np.diag(self.inverse), 0.0))
        rows = [(c, float(b), float(s)) for c, b, s in zip(self.features, self.coef, se)]
        if self.intercept:
            s0 = np.sqrt(self.sigma2 * (1.0 / self.n + self.mean_x @ self.inverse @ self.mean_x))
            rows.insert(0, ("const", self.const, float(s0)))
        out = [(c, b, s, b / s if s else None, t_two_sided(b / s, df) if s else None) for c, b, s in rows]
        return spark.createDataFrame(out, "term string, coefficient double, std_error double, t double, p_value double")


def linear_formula(coefficients: Mapping[str, float], intercept: float = 0.0) -> Column:
    """intercept + sum(coefficient * feature)."""
    return F.lit(float(intercept)) + sum_columns([F.col(c).cast("double") * F.lit(float(b)) for c, b in coefficients.items()])


def apply_formula(df: DataFrame, coefficients: Mapping[str, float], intercept: float, out: str) -> DataFrame:
    missing = [c for c in coefficients if c not in df.columns]
    if missing:
        raise ValueError(f"features not in the data: {missing}")
    return df.withColumn(out, linear_formula(coefficients, intercept))


def solve_ols(g: Gram, target: str, features: Sequence[str], intercept: bool = True) -> LinearModel:
    """Least squares from a Gram; never touches rows."""
    features = list(features)
    s = g.select([*features, target])
    xx, xy, yy = s.cross[:-1, :-1], s.cross[:-1, -1], s.cross[-1, -1]
    mx, my = s.mean[:-1], float(s.mean[-1])
    if not intercept:
        xx, xy = xx + s.n * np.outer(mx, mx), xy + s.n * mx * my
        raw_yy = yy + s.n * my * my
    # Unit-diagonal scaling keeps the inverse well conditioned for mixed units.
    d = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inv = np.linalg.pinv(xx / np.outer(d, d), hermitian=True) / np.outer(d, d)
    coef = inv @ xy
    sse = max(float((yy if intercept else raw_yy) - 2 * coef @ xy + coef @ xx @ coef), 0.0)
    const = float(my - coef @ mx) if intercept else 0.0
    return LinearModel(target, features, intercept, const, coef, s.n, sse, float(yy), mx, my, inv)


def fit_ols(df: DataFrame, target: str, features: Sequence[str], intercept: bool = True) -> LinearModel:
    return solve_ols(gram(df, [*features, target]), target, features, intercept)


def holdout_sse(g: Gram, model: LinearModel) -> tuple[float, float]:
    """(SSE, TSS around its own mean) of ``model`` on the rows behind ``g``, without touching them."""
    s = g.select([*model.features, model.target])
    b = np.append(-model.coef, 1.0)
    bias = s.mean @ b - model.const
    return float(b @ s.cross @ b + s.n * bias * bias), float(s.cross[-1, -1])


def cross_validate(folds: Mapping[object, Gram], target: str, features: Sequence[str], intercept: bool = True) -> dict[str, float]:
    """Mean held-out R2 and RMSE over folds, from per-fold Grams."""
    parts = [g for g in folds.values() if g.n]
    total = parts[0]
    for g in parts[1:]:
        total = total + g
    r2, rmse = [], []
    for g in parts:
        sse, tss = holdout_sse(g, solve_ols(total - g, target, features, intercept))
        r2.append(1.0 - sse / tss if tss > 0 else np.nan)
        rmse.append(np.sqrt(sse / g.n))
    return {"r2cv": float(np.mean(r2)), "rmse_cv": float(np.mean(rmse))}


def cross_validate_external(test: DataFrame, target: str, features: Sequence[str], key: Sequence[str], k: int = 5, intercept: bool = True, seed: int = 42) -> dict[str, float | None]:
    """Q2 and RMSE of k-fold validation inside an external table, one Gram per fold.

    A table of fewer than ``k`` rows gives one fold per row; fewer than two rows give none.
    """
    folds = gram_by(kfold(test, key, k, seed), [*features, target], "fold")
    if sum(g.n > 0 for g in folds.values()) < 2:
        return {"q2cv_ext": None, "rmse_cv_ext": None}
    cv = cross_validate(folds, target, features, intercept)
    return {"q2cv_ext": cv["r2cv"], "rmse_cv_ext": cv["rmse_cv"]}


# ------------------------------------------------------------------ scoring passes


def predictions(df: DataFrame, model: LinearModel) -> DataFrame:
    return df.withColumn("prediction", model.predict()).withColumn("residual", F.col(model.target) - F.col("prediction"))


def williams(df: DataFrame, model: LinearModel, split: str = "split", train: str = "train") -> DataFrame:
    """Leverage, standardised residual and domain flag per row.

    Training residuals are divided by sqrt(1 - h), others by sqrt(1 + h).
    """
    s = float(np.sqrt(model.sigma2))
    h = F.col("leverage")
    spread = F.when(F.col(split) == train, F.greatest(1.0 - h, F.lit(1e-12))).otherwise(1.0 + h)
    scored = predictions(df, model).withColumn("leverage", model.leverage())
    scored = scored.withColumn("std_residual", safe_div(F.col("residual"), F.lit(s) * F.sqrt(spread)))
    return scored.withColumn(
        "in_domain", (h < F.lit(model.h_star)) & (F.abs("std_residual") < F.lit(RESIDUAL_LIMIT))
    )


def domain_coverage(scored: DataFrame, split: str = "split") -> DataFrame:
    return scored.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.col("in_domain").cast("double"))).alias("coverage_pct"),
        F.count_if(~F.col("in_domain")).alias("n_outliers"),
    )


def outlier_report(scored: DataFrame, model: LinearModel, key: Sequence[str], split: str = "split") -> DataFrame:
    """Rows outside the domain with their reason, identifiers and metrics first."""
    high = F.col("leverage") >= F.lit(model.h_star)
    far = F.abs("std_residual") >= F.lit(RESIDUAL_LIMIT)
    reason = first_true([(high & far, F.lit("High leverage & outlier")), (high, F.lit("High leverage"))], F.lit("Outlier residual"))
    rows = scored.where(high | far).withColumns(
        {"WP_Dataset": F.initcap(split), "WP_Leverage": F.col("leverage"), "WP_Std_Residual": F.col("std_residual"), "WP_Reason": reason}
    )
    lead = [*key, "WP_Dataset", "WP_Leverage", "WP_Std_Residual", "WP_Reason", model.target, *model.features]
    return rows.select(*dict.fromkeys(lead))


def coverage_gate(scored: DataFrame, model: LinearModel) -> DataFrame:
    """0 if any |standardised residual| reaches the limit, else % of rows with leverage below h*."""
    return scored.agg(
        F.when(F.bool_or(F.abs("std_residual") >= F.lit(RESIDUAL_LIMIT)), F.lit(0.0))
        .otherwise(100.0 * F.avg((F.col("leverage") < F.lit(model.h_star)).cast("double")))
        .alias("ad_coverage")
    )


def leave_one_out(df: DataFrame, model: LinearModel) -> DataFrame:
    """Q2loo and RMSEloo by the PRESS identity e / (1 - h): one pass, no refits."""
    e = F.col("residual") / F.greatest(1.0 - F.col("leverage"), F.lit(1e-10))
    scored = predictions(df, model).withColumn("leverage", model.leverage())
    return scored.agg(F.sum(e * e).alias("press"), F.count(e).alias("n")).select(
        (1.0 - safe_div(F.col("press"), F.lit(model.tss))).alias("q2loo"),
        F.sqrt(F.col("press") / F.col("n")).alias("rmseloo"), "press",
    )


def metrics_by_split(scored: DataFrame, target: str, prediction: str = "prediction", split: str = "split") -> DataFrame:
    """R2, RMSE and MAE per split value and over all rows, from one aggregation."""
    y, e = F.col(target).cast("double"), F.col(target) - F.col(prediction)
    part = scored.groupBy(split).agg(
        F.count(y).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"),
        F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("tss"),
    )
    # Combining the per-split moments avoids a second pass for the total.
    total = part.agg(
        F.lit("all").alias(split), F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae"),
        F.sum("tss").alias("tss"), F.sum(F.col("n") * F.col("mean")).alias("s1"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("s2"),
    ).select(split, "n", "sse", "sae", (F.col("tss") + F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")).alias("tss"))
    both = part.select(split, "n", "sse", "sae", "tss").unionByName(total)
    return both.select(
        split, "n", (1.0 - safe_div(F.col("sse"), F.col("tss"))).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"),
    )


def external_metrics(scored: DataFrame, model: LinearModel, split: str = "split", test: str = "test") -> DataFrame:
    """Q2 against the training mean, and the sample-form concordance, on the test rows."""
    y, p = F.col(model.target), F.col("prediction")
    d = F.avg(y) - F.avg(p)
    t = y - F.lit(model.mean_y)
    return scored.where(F.col(split) == test).agg(
        F.count(y).alias("n"),
        (1.0 - safe_div(F.sum((y - p) * (y - p)), F.sum(t * t))).alias("q2_ext"),
        safe_div(2.0 * F.covar_samp(y, p), F.var_samp(y) + F.var_samp(p) + d * d).alias("ccc_ext"),
    )


def model_statistics(model: LinearModel) -> dict[str, float]:
    """Fit statistics which follow from n, p, RSS and TSS alone."""
    n, p, k = model.n, len(model.features), model.columns_in_design
    f = ((model.tss - model.sse) / p) / (model.sse / (n - p - 1)) if model.sse > 0 else float("inf")
    return {
        "r2": model.r2,
        "adj_r2": 1.0 - (1.0 - model.r2) * (n - 1) / (n - p - 1),
        "f_stat": f,
        "f_p_value": f_upper(f, p, n - p - 1),
        "aic": n * float(np.log(model.sse / n)) + 2.0 * k,
        "bic": n * float(np.log(model.sse / n)) + float(np.log(n)) * k,
    }


def fold_grams(df: DataFrame, cols: Sequence[str], fold: str) -> dict[object, Gram]:
    return gram_by(df, cols, fold)
