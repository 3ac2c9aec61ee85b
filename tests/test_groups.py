"""Modes, grouped quantiles, strata, candidate tables, external validation and p-values."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import distributions as DI
from assaylake.operators import clean as C
from assaylake.operators import cluster as K
from assaylake.operators import ordered as O
from assaylake.operators import quantiles as Q
from assaylake.operators import regress as G
from assaylake.operators import search as SE
from assaylake.operators import stats as S
from assaylake.operators.gram import gram_by


def test_modes_with_ties_nulls_and_nearly_unique_columns(spark):
    rng = random.Random(4)
    rows = [(rng.choice([3, 1, 2, None]), rng.choice("abcd"), k, None, 7.5 if k % 50 == 0 else float(k), k % 2 == 0) for k in range(6000)]
    df = spark.createDataFrame(rows, "few int, word string, unique long, nothing string, rare double, flag boolean").repartition(5)
    got = C.mode_values(df, df.columns)
    for c, at in zip(df.columns, range(6)):
        n = Counter(r[at] for r in rows if r[at] is not None)
        assert got[c] == (min(v for v in n if n[v] == max(n.values())) if n else None), c
    assert C.mode_values(df.limit(0), ["few", "word"]) == {"few": None, "word": None}
    filled = C.fill_mode(df, ["few"]).where("few is null").count()
    assert filled == 0


def test_only_unproven_columns_are_counted_by_a_shuffle(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 3 AS few", "id AS unique", "id % 7 AS week")
    asked = []
    monkeypatch.setattr(C, "mode_value", lambda _df, c: asked.append(c) or -1)
    assert C.mode_values(df, df.columns) == {"few": 0, "unique": -1, "week": 0} and asked == ["unique"]


def test_imputation_ways(spark):
    df = spark.createDataFrame([(1, None, None, "x", None), (2, 4.0, 5, None, "mean"), (3, None, None, "x", None), (4, 8.0, 1, "y", None)], "id int, m double, f int, w string, t string")
    got = C.impute(df, {"m": "mean", "f": "ffill", "w": "mode", "t": ("constant", "mode")}, ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 6.0, None, "x", "mode"), (2, 4.0, 5, "x", "mean"), (3, 6.0, 5, "x", "mode"), (4, 8.0, 1, "y", "mode")]
    with pytest.raises(ValueError):
        C.impute(df, {"f": "ffill"})


def test_grouped_quantiles_are_the_same_bits_both_ways_with_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if k % 2 else (None if k % 11 == 0 else f"g{k % 7}"), float(v), float(w)) for k, (v, w) in enumerate(zip(rng.normal(size=4000).round(2), rng.normal(size=4000)))]
    df = spark.createDataFrame([*rows, ("empty", None, 1.0)], "g string, v double, w double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    small = {r["g"]: r for r in Q.grouped_quantiles(df, ["g"], ["v", "w"], probs).collect()}
    large = {r["g"]: r for r in Q.grouped_quantiles(df, ["g"], ["v", "w"], probs, small=10).collect()}
    assert set(large) == set(small)
    for g, r in small.items():
        for c in ("v", "w"):
            assert (large[g][c] or None) == (r[c] or None), (g, c)


def test_running_sums_and_joins_of_a_hot_group(spark):
    rows = [(None if k % 3 == 0 else f"g{k % 2}", k, k % 5) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {r["k"]: (r["run"], r["all"]) for r in O.running_in_group(df, ["g"], ["k"], "v", "run", "all").collect()}
    total, run = defaultdict(int), {}
    for g, k, v in rows:
        total[g] += v
        run[k] = total[g]
    assert got == {k: (run[k], total[g]) for g, k, _ in rows}
    per = df.groupBy("g").agg(F.max("k").alias("last"))
    last = {g: max(k for h, k, _ in rows if h == g) for g in (None, "g0", "g1")}
    assert all(r["last"] == last[r["g"]] for r in O.join_group_rows(df, per, ["g"]).collect())


def test_label_sample_over_100_000_strata(spark):
    df = spark.range(250_000).selectExpr("id", "CASE WHEN id < 100000 THEN id ELSE -1 END AS cluster")
    got = {r["cluster"]: r["count"] for r in K.label_sample(df, "cluster", ["id"], 2).groupBy("cluster").count().collect()}
    assert len(got) == 100_001 and got.pop(-1) == 3000 and set(got.values()) == {1}
    with pytest.raises(ValueError):
        K.label_sample(df.withColumn("id", F.lit(1)), "cluster", ["id"], 2).count()


def test_many_candidates_without_a_driver_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12))
    y = x[:, 0] * 2 + x[:, 3] - x[:, 7] + rng.normal(size=300) * 0.3
    names = [f"x{k}" for k in range(12)]
    df = spark.createDataFrame([(*map(float, r), float(t), "test" if k % 5 == 0 else "train", k % 4) for k, (r, t) in enumerate(zip(x, y))], ", ".join(f"{n} double" for n in names) + ", y double, split string, fold int")
    subsets = [[n for j, n in enumerate(names) if k >> j & 1] for k in range(1, 4096)]
    cand = spark.createDataFrame([(s,) for s in subsets * 2], "features array<string>")
    top = SE.candidate_report(df, "y", names, cand, options=SE.ReportOptions(best=3)).collect()
    grams = gram_by(df, [*names, "y"], "split")
    folds = gram_by(df.where("split = 'train'"), [*names, "y"], "fold")
    scored = []
    for s in subsets:
        m = G.solve_ols(grams["train"], "y", s)
        scored.append((SE.external_q2(grams["test"], m), m.r2, G.cross_validate(folds, "y", s)["r2cv"], s))
    best = sorted(scored, key=lambda t: (-t[0], -t[1], -t[2]))[:3]
    assert sorted(tuple(r["features"]) for r in top) == sorted(tuple(t[3]) for t in best)
    assert [r["r2cv"] for r in top] == pytest.approx(sorted((t[2] for t in best), reverse=True))
    strict = SE.candidate_report(df, "y", names, cand.limit(40), options=SE.ReportOptions(best=None, min_r2=0.99, min_q2=0.99))
    assert strict.count() == 0


def test_external_validation_with_fewer_rows_than_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(2 * a + rng.normal())) for k, a in enumerate(rng.normal(size=12))]
    df = spark.createDataFrame(rows, "id int, a double, y double")
    five = G.cross_validate_external(df, "y", ["a"], ["id"])
    assert 0 < five["rmse_cv_ext"] < 3 and five["q2cv_ext"] < 1
    few = G.cross_validate_external(df.limit(4), "y", ["a"], ["id"])
    assert math.isnan(few["q2cv_ext"]) and few["rmse_cv_ext"] > 0  # one row per fold has no spread
    assert G.cross_validate_external(df.limit(1), "y", ["a"], ["id"]) == {"q2cv_ext": None, "rmse_cv_ext": None}


def test_p_values_as_columns(spark):
    rows = [(float(t), int(n)) for t in (0.0, 0.3, 1.0, 2.5, 10.0, -4.0) for n in (1, 2, 3, 4, 5, 30, 1000, 100_000)]
    df = spark.createDataFrame(rows, "t double, n int")
    for r in df.select("t", "n", DI.t_two_sided_of(F.col("t"), F.col("n")).alias("p"), DI.f_upper_of(F.abs("t"), F.lit(3), F.col("n")).alias("f")).collect():
        assert r["p"] == pytest.approx(DI.t_two_sided(r["t"], r["n"]), rel=1e-9, abs=1e-14)
        assert r["f"] == pytest.approx(DI.f_upper(abs(r["t"]), 3, r["n"]), rel=1e-9, abs=1e-14)
        t = abs(r["t"])
        closed = {1: 1 - 2 / math.pi * math.atan(t), 2: 1 - t / math.sqrt(2 + t * t), 4: 1 - t / math.sqrt(4 + t * t) * (3 - t * t / (4 + t * t)) / 2}
        if r["n"] in closed:
            assert r["p"] == pytest.approx(closed[r["n"]], abs=1e-12)
    g = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0), ("c", 1.0, 1.0), ("c", None, 2.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["correlation"], r["p_value"]) for r in S.correlation_by_group(g, ["g"], "x", "y").collect()}
    assert got == {"a": (3, 1.0, 0.0), "b": (3, None, None), "c": (1, None, None)}


def test_p_values_end_with_their_batch_and_keep_nulls(spark):
    rows = [(a, b, x) for a in (0.5, 1.0, 2.5, 40.0, 5000.0) for b in (0.5, 1.5, 300.0) for x in (0.0, 1e-12, 0.2, 0.5, 0.97, 1.0, 1.5, -1.0)]
    df = spark.createDataFrame([*rows, (None, 0.5, 0.5), (0.5, None, 0.5), (0.5, 0.5, None)], "a double, b double, x double")
    got = df.withColumn("v", DI.beta_inc_of(F.col("a"), F.col("b"), F.col("x")))
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()  # no fixed number of steps per row
    for r in got.collect():
        if None in (r["a"], r["b"], r["x"]):
            assert r["v"] is None
        else:
            assert r["v"] == pytest.approx(DI.beta_inc(r["a"], r["b"], min(max(r["x"], 0.0), 1.0)), rel=1e-9, abs=1e-300)
    few = spark.createDataFrame([(0.5, float("nan")), (None, 0.5)], "r double, n double")
    assert [r[0] for r in few.select(DI.beta_inc_of(F.lit(2.0), F.lit(0.5), F.col("n"))).collect()][0] == 1.0
