"""Gram, quantiles and ordered operators against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.operators import ordered as O
from assaylake.operators.gram import gram, gram_array, gram_by
from assaylake.operators.quantiles import exact_quantiles, grouped_quantiles
from assaylake.operators.stats import pairwise_correlation


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 3.0, (500, 4))
    x[:, 3] = x[:, 0] + rng.normal(0, 0.1, 500)
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.loc[::7, "b"] = np.nan
    pdf["g"] = np.where(np.arange(500) % 3 == 0, "hot", [f"g{i % 5}" for i in range(500)])
    pdf["id"] = np.arange(500)
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    return pdf, df


@pytest.mark.parametrize("parts", [1, 8])
def test_gram_matches_numpy_far_from_zero(frame, parts):
    pdf, df = frame
    full = pdf[list("abcd")].dropna()
    g = gram(df.repartition(parts), list("abcd"))
    assert g.n == len(full)
    assert np.allclose(g.covariance(), np.cov(full.T), rtol=1e-9)
    assert np.allclose(g.mean, full.mean(), rtol=1e-13)


def test_gram_arrow_path_equals_expression_path(frame):
    _pdf, df = frame
    wide = df.select(*[(F.col(c) * (i + 1)).alias(f"{c}{i}") for c in "abcd" for i in range(5)], "g")
    names = wide.columns[:-1]
    arrow, short = gram(wide, names), gram(wide, names[:4] + names[15:18])
    assert np.allclose(arrow.select(short.names).cross, gram(wide.dropna(subset=names), short.names).cross, rtol=1e-8)
    per = gram_by(wide, names, "g")
    total = sum(list(per.values())[1:], list(per.values())[0])
    assert total.n == arrow.n and np.allclose(total.cross, arrow.cross, rtol=1e-8)
    first = list(per)[0]
    assert np.allclose((total - per[first] + per[first]).cross, total.cross, rtol=1e-6)


def test_gram_array_skips_rows_with_nulls(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],), ([5.0, 1.0],), (None,)], "x array<double>")
    g = gram_array(df, "x", ["p", "q"])[None]
    assert g.n == 2 and np.allclose(g.mean, [3.0, 1.5])


def test_pairwise_correlation_uses_complete_pairs(frame):
    pdf, df = frame
    want = pdf[list("abcd")].corr().to_numpy()
    got = pairwise_correlation(df, list("abcd"))
    assert np.allclose(got, want, atol=1e-9)
    const = df.withColumn("k", F.lit(4.0))
    assert np.isnan(pairwise_correlation(const, ["a", "k"])[0, 1])


@pytest.mark.parametrize("small", [10_000, 0])
def test_quantiles_both_paths(frame, small):
    pdf, df = frame
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, small=small)
    assert np.allclose(got["a"], pdf["a"].quantile(probs))
    assert np.allclose(got["b"], pdf["b"].quantile(probs))
    g = grouped_quantiles(df, ["g"], ["a", "b"], [0.25, 0.5], small=small).toPandas().set_index("g")
    want = pdf.groupby("g")[["a", "b"]].quantile([0.25, 0.5])
    for name in want.index.get_level_values(0).unique():
        assert np.allclose(g.loc[name, "a"], want.loc[name]["a"])
        assert np.allclose(g.loc[name, "b"], want.loc[name]["b"])


def test_quantiles_with_one_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.0).alias("v"))
    pdf = df.toPandas()["v"]
    probs = [0.2, 0.33, 0.5, 0.99]
    assert np.allclose(exact_quantiles(df, ["v"], probs, small=0)["v"], pdf.quantile(probs))


def test_global_index_and_running_total(spark):
    pdf = pd.DataFrame({"y": np.random.default_rng(2).integers(0, 5, 300), "id": range(300)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = O.with_global_index(df, ["y", "id"]).toPandas().sort_values("pos")
    want = pdf.sort_values(["y", "id"]).reset_index(drop=True)
    assert (got["id"].to_numpy() == want["id"].to_numpy()).all() and (got["pos"].to_numpy() == np.arange(300)).all()
    run = O.running_total(df, ["y", "id"], "y", "s").toPandas().sort_values(["y", "id"])
    assert (run["s"].to_numpy() == want["y"].cumsum().to_numpy()).all()


@pytest.mark.parametrize("by", [None, "g"])
def test_forward_fill_and_previous_cross_partition_borders(spark, by):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"t": rng.permutation(n), "v": rng.normal(size=n), "g": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 40, n).astype(str))})
    pdf.loc[rng.random(n) < 0.8, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(6)
    s = pdf.sort_values("t")
    want = s.groupby("g")["v"].ffill() if by else s["v"].ffill()
    got = O.forward_fill(df, ["t"], "v", "f", by=by).toPandas().sort_values("t")
    assert np.allclose(got["f"].astype(float), want, equal_nan=True)
    prev = O.with_previous(df.withColumn("w", F.col("t") * 2), ["t"], "w", "p", by=by).toPandas().sort_values("t")
    base = s.assign(w=s["t"] * 2)
    expect = base.groupby("g")["w"].shift() if by else base["w"].shift()
    assert np.allclose(prev["p"].astype(float), expect, equal_nan=True)
