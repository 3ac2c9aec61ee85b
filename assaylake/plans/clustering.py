"""Clustering, neighbour and classification queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assaylake.functions.columns import rnd
from assaylake.operators import classify as CL
from assaylake.operators import cluster as K
from assaylake.operators.dbscan import dbscan
from assaylake.operators.neighbors import classify_nearest, k_distance, neighbour_counts
from assaylake.operators.pca import fit_pca
from assaylake.plans.registry import query, sql_round as R
from assaylake.plans.regression import event_features
from assaylake.plans.statistics import EMB, embedding_columns
from assaylake.sources.tables import table

START = np.array([[10.0, 20.0], [40.0, 50.0], [90.0, 80.0]])
EV = "ev AS (SELECT event_id, user_id, event_type, value AS v, (props::JSON ->> '$.k')::DOUBLE AS k FROM events)"


def events_vk(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k")
    )


def _assign(v0, k0, v1, k1, v2, k2):
    d = [f"((v - {a}) ** 2 + (k - {b}) ** 2)" for a, b in ((v0, k0), (v1, k1), (v2, k2))]
    return f"CASE WHEN {d[0]} <= {d[1]} AND {d[0]} <= {d[2]} THEN 0 WHEN {d[1]} <= {d[2]} THEN 1 ELSE 2 END"


STEPS = f"""{EV}, s1 AS (SELECT *, {_assign(10, 20, 40, 50, 90, 80)} AS c FROM ev),
  m1 AS (SELECT avg(v) FILTER (WHERE c = 0) AS v0, avg(k) FILTER (WHERE c = 0) AS k0, avg(v) FILTER (WHERE c = 1) AS v1, avg(k) FILTER (WHERE c = 1) AS k1,
    avg(v) FILTER (WHERE c = 2) AS v2, avg(k) FILTER (WHERE c = 2) AS k2 FROM s1),
  s2 AS (SELECT ev.*, {_assign('v0', 'k0', 'v1', 'k1', 'v2', 'k2')} AS c FROM ev, m1)"""


def stepped(spark, sf):
    """Two mean updates from fixed centres, and the labels they give."""
    ev = events_vk(spark, sf)
    one = K.lloyd_step(ev, ["v", "k"], START)
    return ev, one


@query("clu_01_lloyd_steps", f"WITH {STEPS} SELECT c AS cluster, {R('avg(v)', 7)} AS v, {R('avg(k)', 7)} AS k FROM s2 GROUP BY c")
def _(spark, sf):
    ev, one = stepped(spark, sf)
    two = K.lloyd_step(ev, ["v", "k"], one.centers)
    return two.centers_frame(spark).withColumns({c: rnd(c, 7) for c in ("v", "k")})


@query("clu_01_kmeans")
def _(spark, sf):
    return K.kmeans(events_vk(spark, sf), ["v", "k"], 4).centers_frame(spark)


@query("clu_02_elbow")
def _(spark, sf):
    return K.elbow(events_vk(spark, sf), ["v", "k"])


DB = """p AS (SELECT event_id AS id, epoch_us(ts) / 3.6e9 - 473352 AS a, value AS y FROM events),
  nb AS (SELECT p.id AS src, q.id AS dst FROM p JOIN p q ON q.a BETWEEN p.a - 2.5 AND p.a + 2.5 AND q.y BETWEEN p.y - 2.5 AND p.y + 2.5
    WHERE (p.a - q.a) ** 2 + (p.y - q.y) ** 2 <= 6.25),
  core AS (SELECT src AS id FROM nb GROUP BY src HAVING count(*) >= 6),
  ed AS (SELECT src, dst FROM nb WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core))"""


@query(
    "clu_03_dbscan",
    f"""WITH RECURSIVE {DB}, cc(id, label) USING KEY (id) AS (SELECT id, id FROM core UNION
          SELECT r.id, min(c.label) FROM cc c JOIN ed ON ed.src = c.id JOIN recurring.cc r ON r.id = ed.dst WHERE c.label < r.label GROUP BY r.id),
        num AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS n FROM (SELECT DISTINCT label FROM cc)),
        lab AS (SELECT cc.id, n FROM cc JOIN num USING (label)),
        brd AS (SELECT nb.src AS id, min(n) AS n FROM nb JOIN lab ON lab.id = nb.dst WHERE nb.src NOT IN (SELECT id FROM core) GROUP BY nb.src)
        SELECT p.id AS event_id, coalesce(lab.n, brd.n, -1)::INT AS cluster, lab.n IS NOT NULL AS is_core FROM p LEFT JOIN lab USING (id) LEFT JOIN brd USING (id)""",
)
def _(spark, sf):
    ev = event_features(spark, sf)
    return dbscan(ev, ["a", "y"], "event_id", 2.5, 6).select("event_id", "cluster", "is_core")


@query("jon_11_eps_neighbours", f"WITH {DB} SELECT src AS event_id, count(*) >= 6 AS is_core FROM nb GROUP BY src")
def _(spark, sf):
    """Rows with at least six rows (itself included) within eps, by counting neighbours."""
    found = neighbour_counts(event_features(spark, sf), ["a", "y"], "event_id", 2.5)
    return found.select("event_id", (F.col("neighbours") >= 6).alias("is_core"))


PT = "pt AS (SELECT p_partkey AS id, p_size / 50 AS s, p_retailprice / 2000 AS r FROM part)"


def part_points(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("s"), (F.col("p_retailprice") / 2000.0).alias("r"))


@query(
    "clu_04_k_distance",
    f"""WITH {PT}, d AS (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY (a.s - b.s) ** 2 + (a.r - b.r) ** 2) AS rn, sqrt((a.s - b.s) ** 2 + (a.r - b.r) ** 2) AS d FROM pt a, pt b)
        SELECT id AS p_partkey, {R('d', 9)} AS k_distance FROM d WHERE rn = 5""",
)
def _(spark, sf):
    return k_distance(part_points(spark, sf), ["s", "r"], "p_partkey", 5).withColumn("k_distance", rnd("k_distance", 9))


@query(
    "clu_06_calinski_harabasz",
    f"""WITH {STEPS}, m AS (SELECT avg(v) AS mv, avg(k) AS mk, count(*) AS n FROM s2),
        g AS (SELECT c, count(*) AS nc, avg(v) AS cv, avg(k) AS ck, sum(0) AS z, var_pop(v) * count(*) + var_pop(k) * count(*) AS w FROM s2 GROUP BY c)
        SELECT count(*) AS k, any_value(n) AS n, {R('sum(nc * ((cv - mv) ** 2 + (ck - mk) ** 2)) / (count(*) - 1) / (sum(w) / (any_value(n) - count(*)))', 4)} AS calinski_harabasz FROM g, m""",
)
def _(spark, sf):
    ev, one = stepped(spark, sf)
    t = K.calinski_harabasz(ev.withColumn("cluster", one.assign()), ["v", "k"], "cluster")
    return t.withColumn("calinski_harabasz", rnd("calinski_harabasz", 4))


@query("clu_06_silhouette")
def _(spark, sf):
    ev, one = stepped(spark, sf)
    s = K.silhouette(ev.withColumn("cluster", one.assign()), ["v", "k"], "cluster")
    return spark.createDataFrame([(s,)], "silhouette double")


@query("clu_07_labelled_rows", f"WITH {STEPS} SELECT event_id, v, k, c AS cluster FROM s2")
def _(spark, sf):
    ev, one = stepped(spark, sf)
    return K.labelled(ev.select("v", "event_id", "k"), one.assign(), ["event_id"])


@query("clu_08_profile", f"WITH {STEPS} SELECT c AS cluster, {R('avg(v)', 7)} AS v, {R('avg(k)', 7)} AS k FROM s2 GROUP BY c")
def _(spark, sf):
    ev, one = stepped(spark, sf)
    g = ev.withColumn("cluster", one.assign()).groupBy("cluster").agg(rnd(F.avg("v"), 7).alias("v"), rnd(F.avg("k"), 7).alias("k"))
    return g


@query("agg_10_cluster_sizes", f"WITH {STEPS} SELECT c AS cluster, count(*) AS n, false AS is_noise FROM s2 GROUP BY c")
def _(spark, sf):
    ev, one = stepped(spark, sf)
    return K.cluster_sizes(ev.withColumn("cluster", one.assign()))


@query(
    "clu_09_pca_view",
    f"""WITH {STEPS}, s AS (SELECT avg(v) AS mv, avg(k) AS mk, stddev_pop(v) AS sv, stddev_pop(k) AS sk FROM ev),
        a AS (SELECT event_id, v, k, false AS is_center FROM ev UNION ALL SELECT NULL, unnest([v0, v1, v2]), unnest([k0, k1, k2]), true FROM m1)
        SELECT event_id, is_center, {R('abs((v - mv) / sv + (k - mk) / sk) / sqrt(2)', 6)} AS sum_axis, {R('abs((v - mv) / sv - (k - mk) / sk) / sqrt(2)', 6)} AS diff_axis FROM a, s""",
)
def _(spark, sf):
    ev, one = stepped(spark, sf)
    model = fit_pca(ev, ["v", "k"], 2)
    same = model.weights[0, 0] * model.weights[1, 0] > 0  # which component is the sum of the two standardised columns
    names = ("PC1", "PC2") if same else ("PC2", "PC1")
    t = K.pca_view(ev, one, model, ["event_id"])
    return t.select("event_id", "is_center", rnd(F.abs(names[0]), 6).alias("sum_axis"), rnd(F.abs(names[1]), 6).alias("diff_axis"))


@query(
    "clu_10_label_sample",
    f"""WITH {STEPS}, t AS (SELECT count(*) AS n, greatest(5, floor(count(*) * 2 / 100)) AS total FROM s2), z AS (SELECT c, count(*) AS m FROM s2 GROUP BY c),
        r AS (SELECT event_id, c, row_number() OVER (PARTITION BY c ORDER BY md5('42|' || event_id)) AS rn FROM s2)
        SELECT event_id, r.c AS cluster FROM r JOIN z USING (c), t WHERE rn <= least(greatest(1, floor(m / n * total)), m)""",
)
def _(spark, sf):
    ev, one = stepped(spark, sf)
    return K.label_sample(ev.withColumn("cluster", one.assign()), "cluster", ["event_id"], 2).select("event_id", "cluster")


@query(
    "clu_11_two_way_table",
    f"""WITH m AS (SELECT p_brand AS g, avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
        u AS (UNPIVOT m ON q, e, d, t INTO NAME variable VALUE mean)
        SELECT g AS "group", variable, {R('mean', 6)} AS mean, {R('(mean - avg(mean) OVER (PARTITION BY variable)) / stddev_pop(mean) OVER (PARTITION BY variable)', 6)} AS z, mean = 0 AS is_zero FROM u""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "p_brand"), "l_partkey")
    li = li.selectExpr("p_brand", "l_quantity AS q", "l_extendedprice AS e", "l_discount AS d", "l_tax AS t", "0.0D AS nothing")
    t = K.two_way_table(li, "p_brand", ["q", "e", "d", "t", "nothing"])
    return t.select("group", "variable", rnd("mean", 6).alias("mean"), rnd("z", 6).alias("z"), "is_zero")


@query("clu_12_endpoint_strip", f"SELECT p_brand, {R('avg(p_retailprice)', 6)} AS endpoint FROM part GROUP BY 1")
def _(spark, sf):
    return K.endpoint_strip(table(spark, sf, "part"), "p_brand", "p_retailprice", True).withColumn("endpoint", rnd("endpoint", 6))


@query(
    "clu_13_dominant_category",
    "SELECT p_brand, p_type AS category FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2) WHERE rn = 1",
)
def _(spark, sf):
    return K.dominant_category(table(spark, sf, "part"), "p_brand", "p_type")


# ------------------------------------------------------------------ classification

ROWS = """e AS (SELECT vec_id, label::DOUBLE AS label, embedding AS x, row_number() OVER (ORDER BY md5('42|' || vec_id)) AS rn, count(*) OVER () AS n FROM embeddings),
  s AS (SELECT *, rn <= ceil(n * 0.2 - 1e-9) AS test FROM e)"""


@query(
    "jon_10_nearest_neighbour",
    f"""WITH {ROWS}, d AS (SELECT t.vec_id, t.label, b.label AS p, b.vec_id AS bid, list_sum(list_transform(list_zip(t.x, b.x), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d
          FROM s t JOIN s b ON NOT b.test WHERE t.test)
        SELECT vec_id, any_value(label) AS label, arg_min(p, d) AS prediction, {R('sqrt(min(d))', 6)} AS distance FROM d GROUP BY vec_id""",
)
def _(spark, sf):
    from assaylake.operators.split import random_split

    e = random_split(embedding_columns(spark, sf), ["vec_id"], 0.2)
    return classify_nearest(e.where("split = 'test'"), e.where("split = 'train'"), EMB, "vec_id", "label").withColumn("distance", rnd("distance", 6))


def _nb_sql(rows: str, by: str = "") -> str:
    """Gaussian naive Bayes over all elements, on (fold,) vec_id, label, test, x rows."""
    f = by and by + ", "
    same = lambda a, b: f" AND {a}.{by} = {b}.{by}" if by else ""
    return f"""u AS (SELECT {f}vec_id, label, test, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) AS i FROM {rows}),
        sm AS (SELECT {f}1e-9 * max(w) AS e FROM (SELECT {f}i, var_pop(v) AS w FROM u WHERE NOT test GROUP BY {f}i) GROUP BY {by or "()"}),
        pr AS (SELECT {f}label, count(*) AS nc, sum(count(*)) OVER ({"PARTITION BY " + by if by else ""}) AS n FROM {rows} WHERE NOT test GROUP BY {f}label),
        m AS (SELECT {f}label, i, avg(v) AS m, var_pop(v) AS w FROM u WHERE NOT test GROUP BY {f}label, i),
        sc AS (SELECT {"u." + f if by else ""}u.vec_id, any_value(u.label) AS label, m.label AS k, any_value(ln(pr.nc / pr.n)) - 0.5 * sum(ln(2 * pi() * (m.w + e)) + (v - m.m) ** 2 / (m.w + e)) AS lp
          FROM u JOIN m ON u.i = m.i{same("u", "m")} JOIN pr ON pr.label = m.label{same("pr", "m")} JOIN sm ON TRUE{same("sm", "m")} WHERE u.test GROUP BY {"u." + f if by else ""}u.vec_id, m.label),
        nb AS (SELECT {f}vec_id, any_value(label) AS label, arg_max(k, lp) AS prediction FROM sc GROUP BY {f}vec_id)"""


@query("cls_02_naive_bayes", f"WITH {ROWS}, {_nb_sql('s')} SELECT * FROM nb")
def _(spark, sf):
    return CL.hold_out(embedding_columns(spark, sf), CL.naive_bayes(EMB, "label", ["vec_id"]), ["vec_id"])


@query(
    "cls_07_external",
    f"""WITH s AS (SELECT vec_id, label::DOUBLE AS label, embedding AS x, vec_id % 5 = 0 AS test FROM embeddings), {_nb_sql('s')} SELECT * FROM nb""",
)
def _(spark, sf):
    """A model of one table judged on another one."""
    e = embedding_columns(spark, sf)
    return CL.external(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), CL.naive_bayes(EMB, "label", ["vec_id"]))


@query("cls_01_logistic")
def _(spark, sf):
    return CL.report(CL.hold_out(embedding_columns(spark, sf), CL.logistic_regression(EMB, "label", ["vec_id"]), ["vec_id"]), "label")


@query("cls_03_linear_svc")
def _(spark, sf):
    return CL.report(CL.hold_out(embedding_columns(spark, sf), CL.linear_svc(EMB, "label", ["vec_id"]), ["vec_id"]), "label")


@query("cls_04_nearest_neighbour")
def _(spark, sf):
    return CL.report(CL.hold_out(embedding_columns(spark, sf), CL.nearest_neighbour(EMB, "label", ["vec_id"]), ["vec_id"]), "label")


@query("cls_05_decision_tree")
def _(spark, sf):
    return CL.report(CL.hold_out(embedding_columns(spark, sf), CL.decision_tree(EMB, "label", ["vec_id"], 30), ["vec_id"]), "label")


@query("cls_06_random_forest")
def _(spark, sf):
    return CL.report(CL.hold_out(embedding_columns(spark, sf), CL.random_forest(EMB, "label", ["vec_id"], 200, 30), ["vec_id"]), "label")


@query(
    "cls_07_cross_validated",
    f"""WITH e AS (SELECT vec_id, label::DOUBLE AS label, embedding AS x, (row_number() OVER (ORDER BY md5('42|' || vec_id)) - 1) AS rn, count(*) OVER () AS n FROM embeddings),
        f AS (SELECT *, CASE WHEN rn < (n // 4 + 1) * (n % 4) THEN rn // (n // 4 + 1) ELSE n % 4 + (rn - (n // 4 + 1) * (n % 4)) // (n // 4) END AS part FROM e),
        g AS (SELECT o.fold, vec_id, label, x, f.part = o.fold AS test FROM f, (SELECT DISTINCT part AS fold FROM f) o), {_nb_sql('g', 'fold')},
        a AS (SELECT fold, avg((label = prediction)::INT) AS a FROM nb GROUP BY fold)
        SELECT {R('avg(a)', 8)} AS mean_accuracy, {R('stddev_pop(a)', 8)} AS std_accuracy, count(*) AS folds FROM a""",
)
def _(spark, sf):
    p = CL.cross_validated(embedding_columns(spark, sf), CL.naive_bayes(EMB, "label", ["vec_id"]), ["vec_id"], 4)
    a = CL.fold_accuracy(p, "label")
    return a.withColumns({c: rnd(c, 8) for c in ("mean_accuracy", "std_accuracy")})


PRED = "pr AS (SELECT o_orderkey, (o_orderkey % 4)::DOUBLE AS y, (CASE WHEN o_custkey % 3 = 0 THEN (o_orderkey + o_custkey) % 5 ELSE o_orderkey % 4 END)::DOUBLE AS p FROM orders)"


def predicted_orders(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", (k % 4).cast("double").alias("y"), F.when(c % 3 == 0, (k + c) % 5).otherwise(k % 4).cast("double").alias("prediction"))


@query("cls_08_confusion", f"WITH {PRED} SELECT y AS label, p AS prediction, count(*) AS n FROM pr GROUP BY 1, 2")
def _(spark, sf):
    return CL.confusion(predicted_orders(spark, sf), "y")


@query(
    "cls_08_report",
    f"""WITH {PRED}, c AS (SELECT DISTINCT unnest([y, p]) AS k FROM pr),
        m AS (SELECT k, (SELECT count(*) FROM pr WHERE y = k AND p = k) AS tp, (SELECT count(*) FROM pr WHERE y = k) AS t, (SELECT count(*) FROM pr WHERE p = k) AS g FROM c),
        f AS (SELECT k, tp, t, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS rc FROM m),
        h AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM f)
        SELECT k::INT::VARCHAR AS class, {R('pr', 8)} AS precision, {R('rc', 8)} AS recall, {R('f1', 8)} AS f1, t AS support FROM h
        UNION ALL SELECT 'accuracy', {R('sum(tp) / sum(t)', 8)}, {R('sum(tp) / sum(t)', 8)}, {R('sum(tp) / sum(t)', 8)}, sum(t)::BIGINT FROM h
        UNION ALL SELECT 'macro avg', {R('avg(pr)', 8)}, {R('avg(rc)', 8)}, {R('avg(f1)', 8)}, sum(t)::BIGINT FROM h
        UNION ALL SELECT 'weighted avg', {R('sum(pr * t) / sum(t)', 8)}, {R('sum(rc * t) / sum(t)', 8)}, {R('sum(f1 * t) / sum(t)', 8)}, sum(t)::BIGINT FROM h""",
)
def _(spark, sf):
    r = CL.report(predicted_orders(spark, sf), "y")
    return r.withColumns({c: rnd(c, 8) for c in ("precision", "recall", "f1")})
