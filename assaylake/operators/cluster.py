"""k-means, quality measures and the two-way table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from assaylake.functions.columns import complete_rows, first_true, sum_columns
from assaylake.operators.pca import PcaModel, project
from assaylake.operators.profile import group_mode
from assaylake.operators.ordered import join_group_rows
from assaylake.operators.split import row_hash, stratum_cuts
from assaylake.session import materialize

AT_ONCE = 5  # fits of starting centres that run side by side
RESTARTS = 10  # fixed value: k-means restarts
PLAN_LITERALS = 512  # centre values up to which the centres are written into the plan
TOLERANCE = 1e-4  # fixed value: Spark's, a centre that moves less stands still
ELBOW_STEPS = 20  # fixed value: Spark's default
ZERO = 1e-12  # fixed value: a group mean this small counts as zero


@dataclass
class KMeansResult:
    features: list[str]
    centers: np.ndarray  # sorted, so the numbering does not depend on the restart
    inertia: float

    def squared_distances(self) -> list[Column]:
        return [
            sum_columns([(F.col(c).cast("double") - F.lit(float(v))) * (F.col(c).cast("double") - F.lit(float(v))) for c, v in zip(self.features, m)])
            for m in self.centers
        ]

    def assign(self) -> Column:
        """Number of the nearest centre."""
        return nearest_center(self.features, self.centers)

    def centers_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *map(float, m)) for i, m in enumerate(self.centers)]
        return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"`{c}` double" for c in self.features))


def nearest_center(features: Sequence[str], centers: np.ndarray) -> Column:
    """Number of the nearest centre: one expression for a few centres, Arrow batches for many."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    if centers.size > PLAN_LITERALS:
        squares = (centers * centers).sum(axis=1)

        @F.pandas_udf("int")
        def assign(batch: pd.Series) -> pd.Series:
            if batch.empty:
                return pd.Series([], dtype="int32")
            return pd.Series(np.argmin(squares - 2.0 * np.stack(batch.to_numpy()) @ centers.T, axis=1).astype("int32"))

        return assign(x)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in centers])
    dist = F.transform(table, lambda m: F.aggregate(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return (F.array_position(dist, F.array_min(dist)) - 1).cast("int")


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(df).select("__x")


def _starts(data: DataFrame, settings: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Spark's starting centres for every (k, seed), several at a time."""
    find = inheritable_thread_target(data.sparkSession)(
        lambda s: np.array(KMeans(featuresCol="__x", k=s[0], seed=s[1], maxIter=0).fit(data).clusterCenters())
    )
    with ThreadPool(max(1, min(AT_ONCE, len(settings)))) as pool:
        return pool.map(find, settings)


def _blocks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows without nulls and NaN as bytes of a matrix, one per Arrow batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            x = x[:, ~np.isnan(x).any(axis=0)]
            if x.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    return df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)]).mapInArrow(pack, "x binary").persist(StorageLevel.MEMORY_AND_DISK)


def lloyd(blocks: DataFrame, starts: Sequence[np.ndarray], max_iter: int) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia at the last assignment) of every start; one pass over the rows moves all starts that still move.

    A task sends k times d + 1 sums per start; ends as Spark's does, when no centre moves by more than ``TOLERANCE``.
    """
    centers, cost, moving = [s.copy() for s in starts], [math.inf] * len(starts), list(range(len(starts)))
    for _ in range(max_iter):
        now = [(r, centers[r]) for r in moving]

        def add_up(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((m.shape[1] + 1, len(m))) for _r, m in now]
            costs = np.zeros(len(now))
            for batch in batches:
                for blob in batch.column(0):
                    x = np.frombuffer(blob.as_buffer()).reshape(now[0][1].shape[1], -1)
                    for at, (_r, m) in enumerate(now):
                        dist = np.zeros((len(m), x.shape[1]))
                        for axis, v in enumerate(x):
                            gap = v[None] - m[:, axis, None]
                            dist += gap * gap
                        label = dist.argmin(axis=0)
                        costs[at] += dist.min(axis=0).sum()
                        for axis, v in enumerate(x):
                            sums[at][axis] += np.bincount(label, v, len(m))
                        sums[at][-1] += np.bincount(label, minlength=len(m))
            rows = [np.append(s.ravel(), c) for s, c in zip(sums, costs)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _m in now]), pa.array([v.tolist() for v in rows], pa.list_(pa.float64()))], names=["run", "sums"])

        got = blocks.mapInArrow(add_up, "run long, sums array<double>").collect()  # a row per task and start
        still = []
        for r, old in now:
            total = np.sum([g["sums"] for g in got if g["run"] == r], axis=0)
            cost[r], sums = float(total[-1]), total[:-1].reshape(-1, len(old))
            held = sums[-1] > 0
            new = old.copy()
            new[held] = (sums[:-1, held] / sums[-1, held]).T
            if (((new - old) ** 2).sum(axis=1) > TOLERANCE**2).any():
                still.append(r)
            centers[r] = new
        moving = still
        if not moving:
            break
    return list(zip(centers, cost))


def _fits(df: DataFrame, features: Sequence[str], settings: Sequence[tuple[int, int]] | None, max_iter: int, seed: int = 42) -> list[tuple[int, np.ndarray, float]]:
    """(k, centres, inertia) for every (k, seed); without settings for k = 2 .. min(10, n - 1)."""
    data, blocks = vectors(df, features).persist(StorageLevel.MEMORY_AND_DISK), _blocks(df, features)
    try:
        settings = settings or [(k, seed) for k in range(2, min(10, data.count() - 1) + 1)]
        starts = _starts(data, settings)
        data.unpersist()
        return [(k, *found) for (k, _s), found in zip(settings, lloyd(blocks, starts, max_iter))]
    finally:
        data.unpersist()
        blocks.unpersist()


def kmeans(df: DataFrame, features: Sequence[str], k: int, restarts: int = RESTARTS, seed: int = 42, max_iter: int = 300) -> KMeansResult:
    """The best of several restarts, which share every pass over the rows."""
    fits = _fits(df, features, [(k, seed + i) for i in range(restarts)], max_iter)
    _k, centers, cost = min(fits, key=lambda f: f[2])
    return KMeansResult(list(features), centers[np.lexsort(centers.T[::-1])], float(cost))


def lloyd_step(df: DataFrame, features: Sequence[str], centers: np.ndarray) -> KMeansResult:
    """One assignment and mean update from given centres (k rows come back)."""
    rows = df.select(*features, nearest_center(features, centers).alias("cluster")).groupBy("cluster").agg(
        *[F.avg(c).alias(c) for c in features], F.count(F.lit(1)).alias("n")
    ).collect()
    new = centers.copy()
    for r in rows:
        new[r["cluster"]] = [r[c] for c in features]
    return KMeansResult(list(features), new, math.nan)


def elbow(df: DataFrame, features: Sequence[str], ks: Sequence[int] | None = None, seed: int = 42) -> DataFrame:
    """Inertia for k = 2 .. min(10, n - 1)."""
    fits = _fits(df, features, [(k, seed) for k in ks] if ks else None, ELBOW_STEPS, seed)
    return df.sparkSession.createDataFrame([(k, cost) for k, _centers, cost in fits], "k int, inertia double")


def labelled(df: DataFrame, label: Column, id_cols: Sequence[str], out: str = "cluster") -> DataFrame:
    """Identifiers first, the cluster number last."""
    rest = [c for c in df.columns if c not in id_cols]
    return df.withColumn(out, label).select(*id_cols, *rest, out)


def calinski_harabasz(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Between over within dispersion, from per-cluster means and variances."""
    features = list(features)
    per = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features],
        sum_columns([F.var_pop(c) * F.count(c) for c in features]).alias("within"),
    )
    total = per.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"),
        sum_columns([F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")) - F.pow(F.sum(F.col("n") * F.col(f"m_{c}")), 2) / F.sum("n") for c in features]).alias("b"),
    )
    return total.select("k", "n", F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def silhouette(df: DataFrame, features: Sequence[str], label: str) -> float:
    """Mean silhouette on squared Euclidean distances (computed from cluster sums)."""
    data = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df.withColumn("__label", F.col(label).cast("int")))
    return float(ClusteringEvaluator(featuresCol="__x", predictionCol="__label").evaluate(data))


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(label, "n", (F.col(label) == -1).alias("is_noise"))


def label_sample(df: DataFrame, label: str, key: Sequence[str], density: float, seed: int = 42) -> DataFrame:
    """Rows to label in a plot: max(1, int(share * total)) per cluster, total = max(5, int(n * density / 100)).

    Any number of clusters: the cuts are a table with one row per cluster.
    """
    n = df.count()
    total = max(5, int(n * density / 100))
    m = F.col("size")
    wanted = F.least(F.greatest(F.lit(1), F.floor(m / F.lit(n) * F.lit(total))), m)
    cuts = stratum_cuts(df, key, label, wanted, seed)
    return join_group_rows(df.withColumn("__h", row_hash(key, seed)), cuts, [label], "inner").where(F.col("__h") <= F.col("__cut")).drop("__h", "__cut")


def pca_view(df: DataFrame, result: KMeansResult, model: PcaModel, keep: Sequence[str]) -> DataFrame:
    """Two component scores of the rows and, marked, of the centres."""
    rows = project(df, model, keep, na_policy="null").withColumn("is_center", F.lit(False))
    centers = project(result.centers_frame(df.sparkSession), model, [], na_policy="null").withColumn("is_center", F.lit(True))
    return rows.unionByName(centers, allowMissingColumns=True)


# ------------------------------------------------------------------ two-way table


def two_way_table(df: DataFrame, by: str, variables: Sequence[str]) -> DataFrame:
    """Group means, z-scores over groups and zero flags, one row per group and variable.

    Rows with a null are left out, variables with only zero means dropped. Only
    one row of statistics per variable reaches the driver; groups may be many.
    """
    variables = list(variables)
    group = F.col(by).cast("string").alias("group")
    means = materialize(complete_rows(df.select(by, *variables)).groupBy(group).agg(*[F.avg(c).alias(c) for c in variables]), "means")
    stats = means.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{i}") for i, c in enumerate(variables) for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("top", lambda c: F.max(F.abs(c))))],
    ).first()
    if stats["n"] < 2:
        raise ValueError("at least two groups are needed")
    used = [i for i in range(len(variables)) if stats[f"top_{i}"] > ZERO]
    if len(used) < 2:
        raise ValueError("at least two variables that are not all zero are needed")
    entries = [
        F.struct(
            F.lit(variables[i]).alias("variable"), F.col(variables[i]).alias("mean"),
            ((F.col(variables[i]) - F.lit(stats[f"mean_{i}"])) / F.lit(stats[f"sd_{i}"] or 1.0)).alias("z"), (F.col(variables[i]) == 0.0).alias("is_zero"),
        )
        for i in used
    ]
    return means.select("group", F.explode(F.array(*entries)).alias("e")).select("group", "e.*")


def endpoint_strip(df: DataFrame, by: str, endpoint: str, numeric: bool) -> DataFrame:
    """Mean or mode of an endpoint per group."""
    return df.groupBy(by).agg(F.avg(endpoint).alias("endpoint")) if numeric else group_mode(df, by, endpoint, "endpoint")


def dominant_category(df: DataFrame, by: str, category: str) -> DataFrame:
    return group_mode(df, by, category, "category")


def ranked_labels(label: Column, order: Sequence[int]) -> Column:
    """Renumber clusters in the given order."""
    return first_true([(label == F.lit(c), F.lit(i)) for i, c in enumerate(order)], F.lit(-1))
