"""Classifiers, evaluation modes and the classification report."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import safe_div
from assaylake.operators.forest import RandomForestClassifier
from assaylake.operators.neighbors import classify_nearest
from assaylake.operators.split import kfold, random_split

VAR_SMOOTHING = 1e-9  # fixed value: share of the largest variance added to every variance
MAX_CLASSES = 1000

Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def _ml(make, features: Sequence[str], label: str, key: Sequence[str]) -> Predictor:
    """Wrap a Spark ML classifier as ``(train, test) -> key, label, prediction``."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        stages = [VectorAssembler(inputCols=list(features), outputCol="__x"), make(train)]
        model = Pipeline(stages=stages).fit(train)
        return model.transform(test).select(*key, label, F.col("prediction").cast("double").alias("prediction"))

    return run


def logistic_regression(features, label, key, c: float = 1.0, max_iter: int = 150) -> Predictor:
    """L2 with the penalty weight 1/(C n), as a sum-of-losses formulation has it."""
    return _ml(
        lambda train: LogisticRegression(featuresCol="__x", labelCol=label, maxIter=max_iter, regParam=1.0 / (c * train.count()), standardization=False),
        features, label, key,
    )


def linear_svc(features, label, key, max_iter: int = 100) -> Predictor:
    """One linear machine per class (hinge loss)."""
    return _ml(
        lambda train: OneVsRest(featuresCol="__x", labelCol=label, classifier=LinearSVC(maxIter=max_iter, regParam=1.0 / train.count(), standardization=False), parallelism=4),
        features, label, key,
    )


def decision_tree(features, label, key, max_depth: int = 30, seed: int = 42) -> Predictor:
    return _ml(lambda _t: DecisionTreeClassifier(featuresCol="__x", labelCol=label, maxDepth=max_depth, minInstancesPerNode=1, seed=seed), features, label, key)


def random_forest(features, label, key, trees: int = 200, max_depth: int = 30, seed: int = 42) -> Predictor:
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        forest = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=max_depth, seed=seed)
        vectors = VectorAssembler(inputCols=list(features), outputCol="__x")
        return forest.fit(vectors.transform(train)).transform(vectors.transform(test)).select(*key, label, "prediction")

    return run


def naive_bayes(features, label, key) -> Predictor:
    """Gaussian class likelihoods; one aggregate per fit, one expression per row."""
    features = list(features)

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        rows = train.groupBy(label).agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in features], *[F.var_pop(c).alias(f"v_{c}") for c in features]
        ).orderBy(label).limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        total = train.agg(F.greatest(F.lit(0.0), *[F.var_pop(c) for c in features]).alias("v")).first()["v"]
        n = sum(r["n"] for r in rows)
        smooth = VAR_SMOOTHING * (total or 0.0)
        # Per class the log posterior is a quadratic form held in literal arrays.
        x = F.array(*[F.col(c).cast("double") for c in features])
        scores = []
        for r in rows:
            mean = F.array(*[F.lit(float(r[f"m_{c}"])) for c in features])
            inv = F.array(*[F.lit(1.0 / (r[f"v_{c}"] + smooth)) for c in features])
            const = math.log(r["n"] / n) - 0.5 * sum(math.log(2 * math.pi * (r[f"v_{c}"] + smooth)) for c in features)
            dev = F.zip_with(x, mean, lambda a, b: (a - b) * (a - b))
            q = F.aggregate(F.zip_with(dev, inv, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            scores.append(F.struct((F.lit(const) - 0.5 * q).alias("s"), F.lit(float(-r[label])).alias("neg")))
        best = F.array_max(F.array(*scores))
        return test.select(*key, label, (-best["neg"]).alias("prediction"))

    return run


def nearest_neighbour(features, label, key) -> Predictor:
    """1-NN; ``key`` must be a single column."""

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return classify_nearest(test, train, features, key[0], label).select(*key, label, F.col("prediction").cast("double").alias("prediction"))

    return run


# ------------------------------------------------------------------ evaluation


def hold_out(df: DataFrame, fit: Predictor, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    s = random_split(df, key, test_size, seed)
    return fit(s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split"))


def cross_validated(df: DataFrame, fit: Predictor, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions with their fold."""
    s = kfold(df, key, k, seed)
    out = None
    for i in range(k):
        p = fit(s.where(F.col("fold") != i).drop("fold"), s.where(F.col("fold") == i).drop("fold")).withColumn("fold", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def external(train: DataFrame, test: DataFrame, fit: Predictor) -> DataFrame:
    """Predictions for an external table by a model of the whole training table; columns are matched by name."""
    return fit(train, test.select(*train.columns))


def fold_accuracy(predictions: DataFrame, label: str) -> DataFrame:
    """Mean and population standard deviation of the accuracy over folds."""
    per = predictions.groupBy("fold").agg(F.avg((F.col(label).cast("double") == F.col("prediction")).cast("double")).alias("a"))
    return per.agg(F.avg("a").alias("mean_accuracy"), F.stddev_pop("a").alias("std_accuracy"), F.count(F.lit(1)).alias("folds"))


def confusion(predictions: DataFrame, label: str) -> DataFrame:
    """Counts per (label, prediction); the report below needs only these."""
    return predictions.groupBy(F.col(label).cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def report(predictions: DataFrame, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    c = confusion(predictions, label)
    true, guess = F.col("label"), F.col("prediction")
    as_true = c.select(true.alias("class"), F.when(true == guess, F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"))
    as_guess = c.select(guess.alias("class"), F.lit(0).alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"))
    per = as_true.unionByName(as_guess).groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    zero = F.lit(0.0)
    prec, rec = F.coalesce(safe_div(F.col("tp"), F.col("predicted")), zero), F.coalesce(safe_div(F.col("tp"), F.col("support")), zero)
    f1 = F.coalesce(safe_div(2.0 * prec * rec, prec + rec), zero)
    scored = per.select("class", "tp", "support", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
    rows = scored.select(F.col("class").cast("int").cast("string").alias("class"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    w = lambda m: (F.sum(F.col(m) * F.col("support")) / n).alias(m)
    acc = F.sum("tp") / n
    macro = scored.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")], n.alias("support"))
    weighted = scored.agg(F.lit("weighted avg").alias("class"), *[w(m) for m in ("precision", "recall", "f1")], n.alias("support"))
    accuracy = scored.agg(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support"))
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)

