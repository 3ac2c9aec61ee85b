"""Regression, components, splits and search against numpy."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.functions.distributions import beta_inc, f_upper, t_two_sided
from assaylake.operators import classify
from assaylake.operators import clean as C
from assaylake.operators import pca as PC
from assaylake.operators import pcr as PR
from assaylake.operators import regress as G
from assaylake.operators import search as SE
from assaylake.operators import split as P
from assaylake.operators.gram import gram, gram_by
from assaylake.plans import QUERIES


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 5)) * [1, 5, 0.1, 2, 1] + [0, 100, 0, 3, 0]
    y = 2 + x @ [1.5, -0.3, 10, 0, 0] + rng.normal(0, 0.5, 240)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(5)]).assign(y=y, id=range(240))
    pdf["fold"] = pdf["id"] % 4
    pdf["split"] = np.where(pdf["id"] % 5 == 0, "test", "train")
    return pdf, spark.createDataFrame(pdf)


def _fit(pdf, cols):
    a = np.column_stack([np.ones(len(pdf)), pdf[cols]])
    return a, np.linalg.lstsq(a, pdf["y"], rcond=None)[0]


def test_ols_loo_and_leverage(data):
    pdf, df = data
    cols = ["x0", "x1", "x2"]
    a, b = _fit(pdf, cols)
    m = G.fit_ols(df, "y", cols)
    assert np.allclose([m.const, *m.coef], b)
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    e = pdf["y"] - a @ b
    loo = G.leave_one_out(df, m).first()
    assert math.isclose(loo["press"], ((e / (1 - h)) ** 2).sum(), rel_tol=1e-9)
    w = G.williams(df, m).orderBy("id").toPandas()
    assert np.allclose(w["leverage"], h)
    s = math.sqrt((e**2).sum() / (len(pdf) - 4))
    train = pdf["split"] == "train"
    assert np.allclose(w["std_residual"], np.where(train, e / (s * np.sqrt(1 - h)), e / (s * np.sqrt(1 + h))))


def test_wide_leverage_uses_the_same_values(data):
    pdf, df = data
    m = G.fit_ols(df, "y", ["x0", "x1", "x2"])
    wide = df.select("id", "y", *[(F.col(f"x{i % 5}") * (1 + i) + F.pow(F.col("x0"), F.lit(i % 3)) * F.rand(i)).alias(f"w{i}") for i in range(18)])
    pw = wide.toPandas()
    names = [f"w{i}" for i in range(18)]
    fixed = wide.sparkSession.createDataFrame(pw)
    mw = G.fit_ols(fixed, "y", names)
    a = np.column_stack([np.ones(len(pw)), pw[names]])
    h = np.einsum("ij,jk,ik->i", a, np.linalg.pinv(a.T @ a), a)
    got = fixed.select("id", mw.leverage().alias("h")).orderBy("id").toPandas()["h"]
    assert np.allclose(got, h[np.argsort(pw["id"])], atol=1e-6)
    assert m.h_star == 3 * 4 / 240


def test_no_intercept(data):
    pdf, df = data
    m = G.fit_ols(df, "y", ["x0", "x1"], intercept=False)
    b = np.linalg.lstsq(pdf[["x0", "x1"]], pdf["y"], rcond=None)[0]
    assert np.allclose(m.coef, b) and m.const == 0.0


def test_cross_validation_without_refits(data):
    pdf, df = data
    cols = ["x0", "x1", "x2"]
    r2 = []
    for f in range(4):
        tr, te = pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]
        _a, b = _fit(tr, cols)
        p = np.column_stack([np.ones(len(te)), te[cols]]) @ b
        r2.append(1 - ((te["y"] - p) ** 2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum())
    got = G.cross_validate(gram_by(df, [*cols, "y"], "fold"), "y", cols)
    assert math.isclose(got["r2cv"], np.mean(r2), rel_tol=1e-9)


def test_p_values():
    assert math.isclose(t_two_sided(2.0, 10), 0.07338803477074053, rel_tol=1e-9)
    assert math.isclose(f_upper(3.5, 2, 20), 0.04969, rel_tol=1e-3)
    assert beta_inc(2, 3, 0.0) == 0.0 and beta_inc(2, 3, 1.0) == 1.0
    assert math.isclose(beta_inc(2, 3, 0.5), 0.6875, rel_tol=1e-12)


def test_pca_scores_are_centred_and_uncorrelated(data):
    pdf, df = data
    cols = [f"x{i}" for i in range(5)]
    m = PC.fit_pca(df, cols)
    s = PC.project(df, m, ["id"]).toPandas()[m.names()]
    assert np.allclose(s.mean(), 0, atol=1e-9)
    cov = np.cov(s.T)
    assert np.allclose(cov, np.diag(m.eigenvalues), atol=1e-8)
    load = np.array([[np.corrcoef(pdf[c], s[p])[0, 1] for p in m.names()] for c in cols])
    assert np.allclose(m.loadings(), load, atol=1e-8)
    again = PC.load_pca(m.model_rows(df.sparkSession))
    assert np.allclose(PC.project(df, again, ["id"]).orderBy("id").toPandas()[m.names()], PC.project(df, m, ["id"]).orderBy("id").toPandas()[m.names()])
    sub = PC.refit(m, cols[:3])
    assert np.allclose(sub.eigenvalues, PC.fit_pca(df, cols[:3]).eigenvalues)


def test_projection_rejects_missing_and_null(data, spark):
    _pdf, df = data
    m = PC.fit_pca(df, ["x0", "x1"])
    with pytest.raises(ValueError):
        PC.project(df.drop("x1"), m)
    holed = df.withColumn("x1", F.when(F.col("id") > 3, F.col("x1")))
    with pytest.raises(ValueError):
        PC.project(holed, m)
    assert PC.project(holed, m, na_policy="mean").where("PC1 IS NULL").count() == 0


def test_pcr_with_all_components_is_ols(data):
    pdf, df = data
    cols = ["x0", "x1", "x2"]
    m = PR.fit_pcr(df, "y", cols, "fold")
    _a, b = _fit(pdf, cols)
    got = df.select(m.predict().alias("p"), m.predict_plain().alias("q"), "id").orderBy("id").toPandas()
    want = np.column_stack([np.ones(len(pdf)), pdf[cols]]) @ b
    assert np.allclose(got["p"], want) and np.allclose(got["q"], want)
    best = PR.fit_pcr(df, "y", cols, "fold", optimise=True)
    assert best.components == int(np.argmax(best.cv_r2)) + 1


def test_scaling_from_gram_is_standard_scaling(data):
    _pdf, df = data
    a = C.scaling_parameters(df, ["x0", "x1"])
    b = C.scaling_from_gram(gram(df, ["x0", "x1", "y"]), ["x0", "x1"])
    for c in a:
        assert np.allclose(a[c], b[c])


def test_candidate_report(data):
    _pdf, df = data
    cols = [f"x{i}" for i in range(5)]
    given = df.sparkSession.createDataFrame([(["x0", "x1", "x2"],), (["x0", "x1"],), (["x3", "x4"],)], "features array<string>")
    rep = SE.candidate_report(df, "y", cols, given, options=SE.ReportOptions(best=2, min_r2=0.0, min_q2=0.0)).toPandas()
    assert list(rep["features"][0]) == ["x0", "x1", "x2"] and rep["rank"].tolist() == [1, 2]
    assert rep["r2cv"].is_monotonic_decreasing and rep["equation"][0].count("*") == 3


# ------------------------------------------------------------------ splits


def test_hash_splits_equal_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAVES", 3)  # forces several counting rounds
    df = spark.range(700).withColumnRenamed("id", "k")
    order = sorted(range(700), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    test = {r["k"] for r in P.random_split(df, ["k"], 0.23).where("split = 'test'").collect()}
    assert test == set(order[: math.ceil(700 * 0.23)])
    folds = {r["k"]: r["fold"] for r in P.kfold(df, ["k"], 6).collect()}
    want = {k: i for i, part in enumerate(np.array_split(np.array(order), 6)) for k in part}
    assert folds == want
    strata = df.withColumn("y", (F.col("k") % 7).cast("double"))
    s = P.stratified_split(strata, ["k"], "y", 0.3, 3).toPandas()
    for _b, part in s.groupby("bin"):
        assert (part["split"] == "test").sum() == math.ceil(len(part) * 0.3 - 1e-9)


def test_endpoints_split_with_ties(spark):
    y = [5.0, 1.0, 1.0, 9.0, 9.0, 3.0, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "k int, y double")
    got = {r["k"]: r["split"] for r in P.endpoints_split(df, "y", ["k"], 3).collect()}
    rest = [i for i in sorted(range(7), key=lambda i: (y[i], i)) if i not in (1, 3)]
    want = {i: "test" if i in (1, 3) or rest.index(i) % 3 == 2 else "train" for i in range(7)}
    assert got == want


def test_time_split_with_equal_times(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.timestamp_seconds((F.col("id") / 20).cast("int")).alias("t"))
    train = {r["k"] for r in P.time_split(df, "t", ["k"], 0.3).where("split = 'train'").collect()}
    assert train == set(range(35))


def test_rejected_renames(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        C.rename_columns(df, {"a": "b"})
    with pytest.raises(ValueError):
        C.rename_columns(df, {"a": "c", "b": "c"})
    assert C.rename_columns(df, {"a": " b ", "b": "a"}).columns == ["b", "a"]


def test_split_rejects_keys_that_straddle_the_cut(spark, monkeypatch):
    same = spark.range(300).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="unique"):
        P.random_split(same, ["k"], 0.2)
    monkeypatch.setattr(P, "LEAVES", 3)
    with pytest.raises(ValueError, match="unique"):
        P.random_split(same, ["k"], 0.2)


def test_outliers_by_group_keep_null_groups_and_values(spark):
    rows = [(i, "a" if i % 2 else None, float(i % 5)) for i in range(40)] + [(40, "a", 900.0), (41, None, 900.0), (42, "a", None)]
    got = {r["k"]: r["is_outlier"] for r in C.outlier_flag_by(spark.createDataFrame(rows, "k int, g string, y double"), "y", "g").collect()}
    assert len(got) == 43 and {k for k, v in got.items() if v} == {40, 41}


def test_random_forest_has_no_shallow_limit(spark, monkeypatch):
    """Trees of the query and of the operator's default go as deep as Spark allows."""
    made = []

    class Stop(Exception):
        pass

    def stand_in(**settings):
        made.append(settings)
        raise Stop

    monkeypatch.setattr(classify, "RandomForestClassifier", stand_in)
    with pytest.raises(Stop):
        QUERIES["cls_06_random_forest"](spark, "/root/testdata/sf0.001")
    with pytest.raises(Stop):
        classify.random_forest(["x"], "y", ["id"])(None, None)
    assert [(m["numTrees"], m["maxDepth"]) for m in made] == [(200, 30), (200, 30)]


def test_random_forest_separates_more_than_64_leaves(spark):
    rng = np.random.default_rng(11)
    rows = [(16 * a + b, float(a), float(b), int(rng.integers(0, 2))) for a in range(16) for b in range(16)]
    df = spark.createDataFrame(rows * 4, "id int, a double, b double, y int")
    got = classify.random_forest(["a", "b"], "y", ["id"], trees=20)(df, df).collect()
    assert np.mean([r["y"] == r["prediction"] for r in got]) > 0.97


def test_random_forest_sends_no_histogram_for_small_nodes(spark, monkeypatch):
    """Nodes up to the limit are grown from their rows; splitting by histograms first gives the same trees."""
    from assaylake.operators import forest

    rng = np.random.default_rng(12)
    rows = [(i, *map(float, rng.normal(size=5).round(1)), float(rng.integers(0, 3))) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, y double")
    run = lambda: classify.random_forest(list("abcde"), "y", ["id"], trees=6)(df.where("id < 450"), df.where("id >= 450"))
    calls = []
    real = forest._histogram_splits
    monkeypatch.setattr(forest, "_histogram_splits", lambda *a: calls.append(len(a[2])) or real(*a))
    local = {r["id"]: r["prediction"] for r in run().collect()}
    assert len(local) == 150 and not calls
    monkeypatch.setattr(forest, "LOCAL_WEIGHT", 40)
    monkeypatch.setattr(forest, "HISTOGRAM_NODES", 16)
    assert {r["id"]: r["prediction"] for r in run().collect()} == local and sum(calls) > 60 and max(calls) <= 16


def test_random_forest_leaves_constant_and_large_pure_nodes(spark, monkeypatch):
    from assaylake.operators import forest

    monkeypatch.setattr(forest, "LOCAL_WEIGHT", 20)
    rows = [(i % 90, 1.0, float(i % 2), float(i % 2) if i < 280 else 1.0) for i in range(300)]  # keys repeat
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    got = classify.random_forest(["a", "b"], "y", ["id"], trees=9)(df, df).collect()
    assert len(got) == 300 and np.mean([r["y"] == r["prediction"] for r in got]) > 0.9
    with pytest.raises(ValueError, match="whole numbers"):
        classify.random_forest(["a", "b"], "y", ["id"], trees=2)(df.withColumn("y", F.lit(0.5)), df)
