"""Principal-component regression from per-fold Grams of the training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators.gram import Gram, gram_by
from assaylake.operators.pca import PcaModel, solve_pca
from assaylake.operators.regress import LinearModel, cross_validate, linear_formula, solve_ols

MAX_SEARCHED = 10  # fixed value: components tried when choosing their number


@dataclass
class PcrModel:
    target: str
    pca: PcaModel
    components: int
    linear: LinearModel  # on the scores
    coef: np.ndarray  # per scaled feature
    cv_r2: list[float]
    plain: LinearModel  # ordinary least squares on the scaled features, for comparison

    def predict(self):
        w = self.coef / self.pca.scale
        return linear_formula(dict(zip(self.pca.features, map(float, w))), self.linear.const - float(w @ self.pca.loc))

    def predict_plain(self):
        w = self.plain.coef / self.pca.scale
        return linear_formula(dict(zip(self.pca.features, map(float, w))), self.plain.const - float(w @ self.pca.loc))

    def explained_pct(self) -> float:
        return float(100.0 * self.pca.eigenvalues[: self.components].sum() / self.pca.total_variance)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(c, float(a), float(b)) for c, a, b in zip(self.pca.features, self.coef, self.plain.coef)]
        return spark.createDataFrame(rows, "feature string, pcr_coefficient double, lr_coefficient double")


def fit_pcr(
    train: DataFrame, target: str, features: Sequence[str], fold: str, n_components: int | None = None,
    optimise: bool = False, standardise: bool = True,
) -> PcrModel:
    """One pass over the training rows: everything else is p x p algebra on the fold Grams."""
    folds = gram_by(train, [*features, target], fold)
    total = None
    for g in folds.values():
        total = g if total is None else total + g
    pca = solve_pca(total.select(list(features)), None, standardise)
    rotated = {k: _to_scores(g, pca, target) for k, g in folds.items()}
    whole = _to_scores(total, pca, target)
    names = pca.names()
    limit = min(MAX_SEARCHED, len(names))
    cv = []
    if optimise:
        cv = [cross_validate(rotated, target, names[:k])["r2cv"] for k in range(1, limit + 1)]
        n_components = int(np.argmax(cv)) + 1
    k = min(n_components or len(names), len(names))
    linear = solve_ols(whole, target, names[:k])
    plain = solve_ols(total.scaled(list(features), pca.loc, pca.scale), target, list(features))
    return PcrModel(target, pca, k, linear, pca.weights[:, :k] @ linear.coef, cv, plain)


def _to_scores(g: Gram, pca: PcaModel, target: str) -> Gram:
    """Gram of (scores, target): a rotation of the Gram of (features, target)."""
    s = g.select([*pca.features, target]).scaled(pca.features, pca.loc, pca.scale)
    p, k = pca.weights.shape
    r = np.zeros((p + 1, k + 1))
    r[:p, :k], r[p, k] = pca.weights, 1.0
    return Gram([*pca.names(), target], s.n, s.mean @ r, r.T @ s.cross @ r)


def pcr_scored(df: DataFrame, model: PcrModel) -> DataFrame:
    return df.withColumn("prediction", model.predict()).withColumn("prediction_lr", model.predict_plain()).withColumn(
        "residual", F.col(model.target) - F.col("prediction")
    )
