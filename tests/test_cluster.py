"""Neighbours, density clusters, classifiers against brute force."""

import numpy as np
import pandas as pd
import pytest

from assaylake.operators import classify as CL
from assaylake.operators import cluster as K
from assaylake.operators.dbscan import dbscan
from assaylake.operators.neighbors import k_distance, nearest


def brute_dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core, label, c = near.sum(1) >= m, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                u = stack.pop()
                if core[u]:
                    for v in np.flatnonzero(near[u] & (label < 0)):
                        label[v] = c
                        stack.append(v)
            c += 1
    return label, core


@pytest.mark.parametrize("dims,eps,m", [(2, 0.1, 4), (3, 0.35, 5), (8, 0.9, 4)])
def test_dbscan_equals_brute_force_with_a_third_of_copies(spark, dims, eps, m, monkeypatch):
    import assaylake.operators.boxes as boxes
    import assaylake.operators.dbscan as module

    monkeypatch.setattr(boxes, "LEAF_BOXES", 20)  # forces several leaves

    monkeypatch.setattr(module, "POINT_PAIRS", 4)  # forces finer parts
    monkeypatch.setattr(module, "BUCKET_ROWS", 5)  # forces several buckets per cell
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.4, (120, dims)), rng.uniform(-2, 2, (60, dims)), np.tile(rng.normal(1, 0.01, (1, dims)), (80, 1))]).round(3)
    x = x[rng.permutation(len(x))]
    names = [f"f{i}" for i in range(dims)]
    pdf = pd.DataFrame(x, columns=names).assign(id=range(len(x)))
    got = dbscan(spark.createDataFrame(pdf), names, "id", eps, m).toPandas().sort_values("id")
    label, core = brute_dbscan(x, eps, m)
    assert (got["cluster"].to_numpy() == label).all() and (got["is_core"].to_numpy() == core).all()


def test_dbscan_links_dense_cells_without_comparing_their_rows(spark, monkeypatch):
    import assaylake.operators.dbscan as module

    def stop(*_a):
        raise AssertionError("rows of core cells were compared")

    monkeypatch.setattr(module, "core_edges", stop)
    x = np.random.default_rng(5).uniform(0, 1, (1500, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=range(len(x)))
    got = dbscan(spark.createDataFrame(pdf), ["a", "b"], "id", 0.2, 4).toPandas().sort_values("id")
    label, core = brute_dbscan(x, 0.2, 4)
    assert (got["cluster"].to_numpy() == label).all() and (got["is_core"].to_numpy() == core).all()


def test_dbscan_compares_all_rows_where_the_outermost_leave_cells_apart(spark, monkeypatch):
    """One outermost row per cell, so most links are found only among the other rows; one key is null."""
    import assaylake.operators.boxes as boxes
    import assaylake.operators.dbscan as module
    from pyspark.sql import functions as F

    monkeypatch.setattr(boxes, "LEAF_BOXES", 20)
    monkeypatch.setattr(module, "POINT_PAIRS", 4)
    monkeypatch.setattr(module, "_outer", lambda d: F.array(F.min("x0"), F.min_by("x1", "x0")).alias("outer"))
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.25, (90, 2)) for c in ((0, 0), (1.1, 0.2), (0.1, 1.3), (3, 3))])
    x = x[rng.permutation(len(x))]
    rows = [(i if i != 100 else None, float(a), float(b)) for i, (a, b) in enumerate(x)]
    got = dbscan(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], "id", 0.12, 4).toPandas().sort_values("id")
    label, core = brute_dbscan(x, 0.12, 4)
    keyed = np.arange(len(x)) != 100
    assert (got["cluster"].to_numpy()[:-1] == label[keyed]).all() and (got["is_core"].to_numpy()[:-1] == core[keyed]).all()


def test_nearest_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (150, 3)), np.zeros((70, 3))]).round(2)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))
    df = spark.createDataFrame(pdf)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = nearest(df, df, list("abc"), "id", "id", 3, block_rows=25).toPandas().sort_values(["query_id", "rank"])
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert (got["base_id"].to_numpy().reshape(-1, 3) == order).all()
    kd = k_distance(df, list("abc"), "id", 5, block_rows=25).toPandas().sort_values("id")
    assert np.allclose(kd["k_distance"], np.sort(d, axis=1)[:, 4])


def test_nearest_in_clusters_ties_nulls_and_small_tables(spark, monkeypatch):
    import assaylake.operators.neighbors as module

    monkeypatch.setattr(module, "QUERY_ROWS", 50)  # forces several crowds per block
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.05, (60, 5)) for c in range(6)] + [np.full((90, 5), 2.5)])
    x = x[rng.permutation(len(x))]
    names = list("abcde")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x))))
    odd = spark.createDataFrame([(900, None, 0.0, 0.0, 0.0, 0.0), (901, float("nan"), 0.0, 0.0, 0.0, 0.0)], "id long, a double, b double, c double, d double, e double")
    both = df.unionByName(odd)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k in (1, 7):
        got = nearest(both, both, names, "id", "id", k, block_rows=20).toPandas().sort_values(["query_id", "rank"])
        assert (got["base_id"].to_numpy().reshape(-1, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()
    few = nearest(df, df.where("id < 3"), names, "id", "id", 5, block_rows=1).toPandas()
    assert len(few) == 3 * len(x) and nearest(df, df.limit(0), names, "id", "id").count() == 0
    assert module.block_share(df, df, names, "id", "id", 0.1, block_rows=20) < 0.4
    counts = {r["id"]: r["neighbours"] for r in module.neighbour_counts(both, names, "id", 0.12, block_rows=20).collect()}
    assert counts.pop(900) == counts.pop(901) == 0 and counts == dict(enumerate((d <= 0.12).sum(1).tolist()))


def test_near_boxes_equal_all_pairs():
    from assaylake.operators.boxes import near

    rng = np.random.default_rng(5)
    for d in (1, 3, 8):
        low = rng.uniform(0, 3, (700, d)).round(1)
        high = low + rng.uniform(0, 0.3, (700, d))
        gap = np.maximum(np.maximum(low[None] - high[:, None], low[:, None] - high[None]), 0)
        want = {(a, b) for a, b in zip(*np.nonzero((gap**2).sum(2) <= 0.25))}
        got = [(a, b) for x, y in near(low, high, low, high, 0.5) for a, b in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_kmeans_assignment_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"])
    df = spark.createDataFrame(pdf)
    r = K.kmeans(df, ["a", "b"], 3, restarts=2)
    plain = [x["c"] for x in df.select(r.assign().alias("c")).collect()]
    monkeypatch.setattr(K, "PLAN_LITERALS", 0)
    assert plain == [x["c"] for x in df.select(r.assign().alias("c")).collect()]
    d = ((pdf.to_numpy()[:, None] - r.centers[None]) ** 2).sum(2)
    assert abs(d.min(1).sum() - r.inertia) < 1e-6


def test_two_way_table_rejects_degenerate_input(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 2.0)], "g string, x double, y double")
    with pytest.raises(ValueError):
        K.two_way_table(df, "g", ["x", "y"])


def test_report_matches_hand_counts(spark):
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 1 + [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 1 + [(2.0, 0.0)] * 2
    df = spark.createDataFrame(rows, "y double, prediction double")
    r = CL.report(df, "y").toPandas().set_index("class")
    assert r.loc["0", "precision"] == 5 / 8 and r.loc["0", "recall"] == 5 / 6 and r.loc["2", "f1"] == 0.0
    assert abs(r.loc["accuracy", "f1"] - 8 / 12) < 1e-12 and r.loc["macro avg", "support"] == 12


def test_dbscan_keeps_rows_with_nulls_as_noise(spark):
    rows = [(i, 0.1 * (i % 3), 0.0) for i in range(12)] + [(12, None, 0.0), (13, float("nan"), 0.0)]
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in dbscan(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], "id", 0.5, 3).collect()}
    assert len(got) == 14 and got[12] == got[13] == (-1, False) and got[0][0] == 0


def test_neighbour_counts_list_no_pairs_of_rows(spark, monkeypatch):
    """Copies, dense and thin places, several leaves and parts; no block of rows meets its queries pair by pair."""
    import assaylake.operators.counting as counting
    import assaylake.operators.neighbors as module

    def stop(*_a):
        raise AssertionError("rows were dealt to blocks")

    monkeypatch.setattr(module, "visits", stop)
    rng = np.random.default_rng(21)
    for d, eps in ((1, 0.2), (2, 0.3), (3, 0.5)):
        x = np.vstack([rng.uniform(0, 3, (300, d)), rng.normal(1, 0.05, (300, d)), np.tile(rng.normal(2, 0.1, (1, d)), (100, 1))]).round(2)
        names = [f"f{j}" for j in range(d)]
        df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x))))
        want = (sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(d)) <= eps * eps).sum(1)
        for visitors in (1 << 19, 150):
            monkeypatch.setattr(counting, "VISITORS", visitors)
            got = {r["id"]: r["neighbours"] for r in module.neighbour_counts(df, names, "id", eps, block_rows=60).collect()}
            assert [got[i] for i in range(len(x))] == want.tolist()


def test_counting_measures_few_pairs_in_dense_places(monkeypatch):
    import assaylake.operators.counting as counting

    rng = np.random.default_rng(22)
    x = rng.uniform(0, 1, (6000, 2))
    seen = []
    real = counting._reach
    monkeypatch.setattr(counting, "_reach", lambda p, low, high: seen.append(len(p)) or real(p, low, high))
    got = counting.count_within(x, x, np.full(6000, 3), 0.16)
    some = rng.choice(6000, 50)
    assert (got[some] == 3 * (((x[some, None] - x[None]) ** 2).sum(2) <= 0.16).sum(1)).all()
    assert sum(seen) < 6000 * 6000 / 20


def test_kmeans_restarts_share_their_passes_and_equal_spark(spark, monkeypatch):
    rng = np.random.default_rng(23)
    pdf = pd.DataFrame(np.vstack([rng.normal(c, 1, (60, 2)) for c in (0, 3, 7)]), columns=["a", "b"])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "a double, b double"))
    real, iterations = K.KMeans, []
    monkeypatch.setattr(K, "KMeans", lambda **s: iterations.append(s.get("maxIter")) or real(**s))
    got = K.kmeans(df, ["a", "b"], 4, restarts=3)
    assert iterations == [0, 0, 0]
    data = K.vectors(df, ["a", "b"]).persist()
    plain = [real(featuresCol="__x", k=4, seed=42 + i, maxIter=300).fit(data) for i in range(3)]
    best = min(plain, key=lambda m: m.summary.trainingCost)
    assert abs(best.summary.trainingCost - got.inertia) < 1e-6
    want = np.array(best.clusterCenters())
    assert np.allclose(want[np.lexsort(want.T[::-1])], got.centers, atol=1e-9)
    costs = {r["k"]: r["inertia"] for r in K.elbow(df, ["a", "b"], [2, 5]).collect()}
    assert all(abs(costs[k] - real(featuresCol="__x", k=k, seed=42).fit(data).summary.trainingCost) < 1e-6 for k in (2, 5))
