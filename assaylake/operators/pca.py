"""Principal components from the covariance of one pass, kept as model rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions.columns import numeric_columns, sum_columns
from assaylake.operators.clean import null_counts
from assaylake.operators.gram import Gram, gram

REASON_LIMIT = 0.3  # fixed value: |loading| reported as a selection reason


@dataclass
class PcaModel:
    """Column-sized: location, scale, weights (features x components), eigenvalues."""

    features: list[str]
    loc: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    eigenvalues: np.ndarray
    total_variance: float
    gram: Gram  # of the scaled features
    sd: np.ndarray  # standard deviation of the scaled features

    @property
    def n_components(self) -> int:
        return self.weights.shape[1]

    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.n_components)]

    def score_columns(self) -> list[Column]:
        x = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.features, self.loc, self.scale)]
        return [
            sum_columns([v * F.lit(float(w)) for v, w in zip(x, self.weights[:, k])]).alias(name)
            for k, name in enumerate(self.names())
        ]

    def loadings(self) -> np.ndarray:
        """Correlation of each feature with each score; 0 for a constant feature."""
        with np.errstate(divide="ignore", invalid="ignore"):
            l = self.weights * np.sqrt(np.maximum(self.eigenvalues, 0.0)) / self.sd[:, None]
        return np.clip(np.where(self.sd[:, None] > 1e-10, l, 0.0), -1.0, 1.0)

    def covariance_loadings(self) -> np.ndarray:
        """weight * sqrt(eigenvalue), cut to [-1, 1]."""
        return np.clip(self.weights * np.sqrt(np.maximum(self.eigenvalues, 0.0)), -1.0, 1.0)

    def variance_table(self, spark: SparkSession) -> DataFrame:
        share = 100.0 * self.eigenvalues / self.total_variance
        rows = [(i + 1, float(e), float(s)) for i, (e, s) in enumerate(zip(self.eigenvalues, share))]
        t = spark.createDataFrame(rows, "component int, eigenvalue double, explained_pct double")
        return t.withColumn("cumulative_pct", F.sum("explained_pct").over(Window.orderBy("component")))  # one row per component

    def loading_rows(self, spark: SparkSession, kind: str = "correlation") -> DataFrame:
        m = self.loadings() if kind == "correlation" else self.covariance_loadings()
        rows = [(c, k + 1, float(m[i, k])) for i, c in enumerate(self.features) for k in range(self.n_components)]
        return spark.createDataFrame(rows, "feature string, component int, loading double")

    def model_rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table, for ``write.parquet``."""
        rows = [
            (c, i, float(self.loc[i]), float(self.scale[i]), [float(w) for w in self.weights[i]], [float(e) for e in self.eigenvalues])
            for i, c in enumerate(self.features)
        ]
        return spark.createDataFrame(
            rows, "feature string, position int, loc double, scale double, weights array<double>, eigenvalues array<double>"
        )


def load_pca(rows: DataFrame) -> PcaModel:
    r = rows.orderBy("position").collect()
    names = [x["feature"] for x in r]
    w = np.array([x["weights"] for x in r])
    loc, sc = np.array([x["loc"] for x in r]), np.array([x["scale"] for x in r])
    e = np.array(r[0]["eigenvalues"])
    empty = Gram(names, 0, np.zeros(len(names)), np.zeros((len(names), len(names))))
    return PcaModel(names, loc, sc, w, e, float(e.sum()), empty, np.ones(len(names)))


def solve_pca(g: Gram, n_components: int | None = None, standardise: bool = True) -> PcaModel:
    """Eigen-decomposition of the p x p covariance; largest weight of each component positive."""
    sd_pop = np.sqrt(np.diag(g.cross) / g.n)
    scale = np.where(sd_pop > 1e-12 * np.maximum(np.abs(g.mean), 1.0), sd_pop, 1.0) if standardise else np.ones(len(g.names))
    s = g.scaled(g.names, g.mean, scale)
    cov = s.covariance(1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    k = min(n_components or len(g.names), len(g.names), max(g.n, 1))
    top = np.argmax(np.abs(vectors), axis=0)
    vectors = vectors * np.where(vectors[top, range(len(top))] < 0, -1.0, 1.0)
    return PcaModel(
        list(g.names), g.mean.copy(), scale, vectors[:, :k], values[:k], float(np.trace(cov)), s, np.sqrt(np.diag(cov))
    )


def pca_features(df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Numeric columns without nulls."""
    cols = list(features or numeric_columns(df))
    holes = null_counts(df.select(*cols))
    return [c for c in cols if not holes[c]]


def fit_pca(
    df: DataFrame, features: Sequence[str] | None = None, n_components: int | None = None, standardise: bool = True,
    na_policy: str = "drop_columns",
) -> PcaModel:
    """``na_policy``: drop columns with nulls, or fill them with the column mean."""
    if na_policy == "drop_columns":
        return solve_pca(gram(df, pca_features(df, features)), n_components, standardise)
    if na_policy != "mean":
        raise ValueError(f"unknown na_policy: {na_policy}")
    cols = list(features or numeric_columns(df))
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in cols])
    return solve_pca(gram(filled, cols), n_components, standardise)


def refit(model: PcaModel, features: Sequence[str], n_components: int | None = None) -> PcaModel:
    """The model on fewer features: a sub-matrix of the same Gram, no new pass."""
    at = [model.features.index(c) for c in features]
    sub = solve_pca(model.gram.select(features), n_components, standardise=False)
    sub.loc, sub.scale = model.loc[at], model.scale[at]
    return sub


def project(df: DataFrame, model: PcaModel, keep: Sequence[str] = (), na_policy: str = "reject") -> DataFrame:
    """Scores of new rows with a stored model; works on batch and streaming frames.

    ``na_policy='mean'`` uses the stored training mean for a missing value;
    'null' leaves the scores NULL; 'reject' raises (batch frames only).
    """
    missing = [c for c in model.features if c not in df.columns]
    if missing:
        raise ValueError(f"features not in the data: {missing}")
    if na_policy == "reject" and not df.isStreaming:
        holes = {c: n for c, n in null_counts(df.select(*model.features)).items() if n}
        if holes:
            raise ValueError(f"nulls in {holes}")
    if na_policy == "mean":
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in zip(model.features, model.loc)})
    return df.select(*keep, *model.score_columns())


# ------------------------------------------------------------- loading tables (features x components)


def importance(loadings: DataFrame) -> DataFrame:
    """Largest |loading| per feature and its rank."""
    t = loadings.groupBy("feature").agg(F.max(F.abs("loading")).alias("importance"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def top_per_component(loadings: DataFrame, components: Sequence[int], n: int) -> DataFrame:
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return (
        loadings.where(F.col("component").isin(*components))
        .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
        .select("feature").distinct()
    )


def above_threshold(loadings: DataFrame, threshold: float) -> DataFrame:
    return loadings.where(F.abs("loading") >= threshold).select("feature").distinct()


def top_loadings(loadings: DataFrame, components: Sequence[int], n: int = 50) -> DataFrame:
    return (
        loadings.where(F.col("component").isin(*components))
        .groupBy("feature").agg(F.sum(F.abs("loading")).alias("strength"))
        .orderBy(F.desc("strength"), "feature").limit(n)
    )


def biplot_arrows(loadings: DataFrame, x: int, y: int, n: int, rule: str = "magnitude") -> DataFrame:
    """Arrows for the strongest features: by length, or the top ``n`` per axis."""
    wide = loadings.groupBy("feature").agg(
        F.max(F.when(F.col("component") == x, F.col("loading"))).alias("lx"),
        F.max(F.when(F.col("component") == y, F.col("loading"))).alias("ly"),
    ).withColumn("magnitude", F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly")))
    if rule == "magnitude":
        return wide.orderBy(F.desc("magnitude"), "feature").limit(n)
    return wide.join(top_per_component(loadings, [x, y], n), "feature", "left_semi")


def feature_report(loadings: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Importance, strongest component with sign, and reasons at |loading| >= 0.3."""
    strong = F.struct("component", F.concat(F.lit("PC"), F.col("component").cast("string"), F.lit(":"),
                                            F.format_string("%.3f", F.abs("loading"))).alias("text"))
    listed = F.array_sort(F.collect_list(F.when(F.abs("loading") >= REASON_LIMIT, strong)))
    best = F.max_by(F.struct("component", "loading"), F.struct(F.abs("loading"), (-F.col("component")).alias("c")))
    report = loadings.groupBy("feature").agg(
        F.max(F.abs("loading")).alias("max_abs_loading"), best.alias("best"),
        F.array_join(F.transform(listed, lambda s: s["text"]), "; ").alias("selection_reason"),
    )
    report = report.join(importance(loadings), "feature")
    report = report.join(selected, "feature", "left_semi") if selected is not None else report
    return report.select(
        "feature", "rank", "importance", "max_abs_loading",
        F.concat(F.lit("PC"), F.col("best.component").cast("string")).alias("max_loading_pc"),
        F.col("best.loading").alias("max_loading_value"), "selection_reason",
    )
