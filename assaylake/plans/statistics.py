"""Correlation, composite screens, distribution statistics and ordered-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.columns import rnd
from assaylake.functions.distributions import normal_quantile
from assaylake.operators import ordered as O
from assaylake.operators import stats as S
from assaylake.operators.gram import gram, gram_array, matrix_frame
from assaylake.plans.cleaning import HOLEY, MEASURES, holey
from assaylake.plans.registry import query, sql_round as R
from assaylake.sources.tables import table

EMB = [f"e{i:02d}" for i in range(64)]


def embedding_columns(spark, sf):
    """The 64 vector elements as named double columns."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(EMB)],
    )


def _pairs_sql(cols, body):
    return " UNION ALL ".join(body.format(a=a, b=b) for a in cols for b in cols)


@query(
    "sta_01_gram",
    "WITH " + HOLEY + ", c AS (SELECT * FROM holey WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL) "
    + _pairs_sql(MEASURES, "SELECT '{a}' AS row, '{b}' AS col, " + R("covar_samp({a}, {b})", 4) + " AS cov FROM c"),
)
def _(spark, sf):
    g = gram(holey(spark, sf), MEASURES)
    return matrix_frame(spark, MEASURES, g.covariance(), "cov").withColumn("cov", rnd("cov", 4))


@query(
    "sta_01_gram_array",
    f"""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings)
        SELECT printf('e%02d', a.i) AS row, printf('e%02d', b.i) AS col, {R('covar_samp(a.v, b.v)', 8)} AS cov
        FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    g = gram_array(table(spark, sf, "embeddings"), "embedding", EMB)[None]
    return matrix_frame(spark, EMB, g.covariance(), "cov").withColumn("cov", rnd("cov", 8))


@query(
    "sta_02_target_correlations",
    "SELECT feature, " + R("r", 7) + " AS correlation, " + R("abs(r)", 7) + " AS abs_correlation, n FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count({c}) AS n FROM holey" for c in ("l_quantity", "l_discount", "l_tax")
    ).join(["WITH " + HOLEY + " ", ""]) + ")",
)
def _(spark, sf):
    t = S.target_correlations(holey(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return t.select("feature", rnd("correlation", 7).alias("correlation"), rnd("abs_correlation", 7).alias("abs_correlation"), "n")


LONG = "el AS (SELECT vec_id, label::DOUBLE AS y, printf('e%02d', unnest(range(64))) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query("sta_02_target_correlations_wide", f"WITH {LONG} SELECT f AS feature, {R('corr(v, y)', 8)} AS correlation, count(*) AS n FROM el GROUP BY f")
def _(spark, sf):
    return S.target_correlations(embedding_columns(spark, sf), "label", EMB).select("feature", rnd("correlation", 8).alias("correlation"), "n")


@query(
    "sta_03_correlation_matrix",
    "WITH " + HOLEY + " " + _pairs_sql(MEASURES, "SELECT '{a}' AS row, '{b}' AS col, " + R("abs(corr({a}, {b}))", 7) + " AS r FROM holey")
    + " UNION ALL SELECT 'fixed', c, NULL FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('fixed')) t(c)"
    + " UNION ALL SELECT c, 'fixed', NULL FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(c)",
)
def _(spark, sf):
    df = holey(spark, sf).withColumn("fixed", F.lit(2.0))
    return S.correlation_matrix(df, MEASURES + ["fixed"]).withColumn("r", rnd("r", 7))


@query(
    "sta_04_correlation_strength",
    "WITH " + HOLEY + ", m AS (" + _pairs_sql(MEASURES, "SELECT '{a}' AS c, abs(corr({a}, {b})) AS r FROM holey")
    + ") SELECT c AS \"column\", " + R("sum(r) - 1", 7) + " AS strength FROM m GROUP BY 1 ORDER BY sum(r) DESC LIMIT 3",
)
def _(spark, sf):
    return S.correlation_strength(holey(spark, sf), MEASURES, top=3).withColumn("strength", rnd("strength", 7))


def _composite_sql():
    feats = ["l_quantity", "l_discount", "l_tax"]
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in feats)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1 :]]
    body = " UNION ALL ".join(
        f"SELECT least('{a}', '{b}') || '+' || greatest('{a}', '{b}') AS combo, corr((z_{a} + z_{b}) / 2, y) AS r, count(*) AS n FROM z" for a, b in pairs
    )
    return (
        f"WITH z AS (SELECT l_extendedprice * (1 - l_discount) AS y, {z} FROM lineitem) "
        f"SELECT combo, {R('r', 7)} AS correlation, n FROM ({body})"
    )


@query("sta_05_composite_correlations", _composite_sql())
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    t = S.composite_correlations(li, "y", ["l_quantity", "l_discount", "l_tax"], size=2)
    combo = F.array_join(F.array_sort(F.split("label", " \\+ ")), "+")
    return t.select(combo.alias("combo"), rnd("correlation", 7).alias("correlation"), "n")


@query(
    "sta_05_composite_correlations_wide",
    f"""WITH {LONG}, ry AS (SELECT f, corr(v, y) AS r FROM el GROUP BY f), pool AS (SELECT f, r FROM ry ORDER BY abs(r) DESC LIMIT 20),
        rr AS (SELECT a.f AS f, b.f AS g, corr(a.v, b.v) AS r FROM el a JOIN el b USING (vec_id) WHERE a.f IN (SELECT f FROM pool) AND b.f IN (SELECT f FROM pool) AND a.f < b.f GROUP BY 1, 2),
        co AS (SELECT a.f || '+' || b.f || '+' || c.f AS combo, (a.r + b.r + c.r) / sqrt(3 + 2 * (x.r + y.r + z.r)) AS r FROM pool a JOIN pool b ON a.f < b.f JOIN pool c ON b.f < c.f
          JOIN rr x ON x.f = a.f AND x.g = b.f JOIN rr y ON y.f = a.f AND y.g = c.f JOIN rr z ON z.f = b.f AND z.g = c.f)
        SELECT combo, {R('r', 8)} AS correlation FROM co ORDER BY abs(r) DESC LIMIT 50""",
)
def _(spark, sf):
    t = S.composite_correlations(embedding_columns(spark, sf), "label", EMB, size=3, pool=20, top=50)
    return t.select(F.array_join(F.array_sort(F.split("label", " \\+ ")), "+").alias("combo"), rnd("correlation", 8).alias("correlation"))


def _group_r2(a, b, y="y"):
    r = {k: f"corr({k[0]}, {k[1]})" for k in ((a, y), (b, y), (a, b))}
    return (
        f"({r[(a, y)]} * {r[(a, y)]} + {r[(b, y)]} * {r[(b, y)]} - 2 * {r[(a, y)]} * {r[(b, y)]} * {r[(a, b)]})"
        f" / (1 - {r[(a, b)]} * {r[(a, b)]})"
    )


@query(
    "sta_06_group_correlations",
    "WITH l AS (SELECT *, l_extendedprice * (1 - l_discount) AS y FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{g} + {h}' AS groups, 2 AS n_descriptors, {R(f'(abs(corr({a}, y)) + abs(corr({b}, y))) / 2', 7)} AS avg_correlation, "
        f"{R(f'greatest(abs(corr({a}, y)), abs(corr({b}, y)))', 7)} AS max_correlation, {R(_group_r2(a, b), 7)} AS r2_score FROM l"
        for g, h, a, b in (("amount", "rebate", "l_quantity", "l_discount"), ("amount", "duty", "l_quantity", "l_tax"), ("rebate", "duty", "l_discount", "l_tax"))
    ),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    t = S.group_correlations(li, "y", {"amount": ["l_quantity"], "rebate": ["l_discount"], "duty": ["l_tax"]}, 2)
    return t.select("groups", "n_descriptors", *[rnd(c, 7).alias(c) for c in ("avg_correlation", "max_correlation", "r2_score")])


@query(
    "sta_07_regression_line",
    f"""SELECT l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)', 5)} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
        {R('regr_r2(l_extendedprice, l_quantity)', 9)} AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    t = S.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", by="l_returnflag")
    return t.select("l_returnflag", rnd("slope", 5).alias("slope"), rnd("intercept", 4).alias("intercept"), rnd("r2", 9).alias("r2"), "n")


K2_SQL = """
  c AS (SELECT count(v) AS n, avg(v) AS m FROM x),
  d AS (SELECT n, m, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM x, c GROUP BY n, m),
  s AS (SELECT n::DOUBLE AS n, m, sqrt(m2) AS sd, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 - 3 AS g2 FROM d),
  a1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
     sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2 FROM s),
  a2 AS (SELECT *, sqrt(2 / (w2 - 1)) AS al,
     (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x2,
     6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM a1),
  a3 AS (SELECT *, ln(y / al + sqrt((y / al) ** 2 + 1)) / sqrt(0.5 * ln(w2)) AS z1,
     6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) AS aa FROM a2),
  a4 AS (SELECT *, (1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x2 * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM a3)"""


@query(
    "sta_08_distribution",
    f"""WITH x AS (SELECT ln(o_totalprice) AS v FROM orders), {K2_SQL}
        SELECT n::BIGINT AS n, {R('m')} AS mean, {R('sd')} AS std, {R('(SELECT quantile_cont(v, 0.5) FROM x)')} AS median,
        {R('g1')} AS skewness, {R('g2')} AS kurtosis FROM a4""",
)
def _(spark, sf):
    d = S.distribution_stats(table(spark, sf, "orders").select(F.ln("o_totalprice").alias("v")), "v")
    return d.select("n", *[rnd(c).alias(c) for c in ("mean", "std", "median", "skewness", "kurtosis")])


@query(
    "sta_09_normality",
    f"""WITH x AS (SELECT c_acctbal AS v FROM customer), {K2_SQL}
        SELECT n::BIGINT AS n, {R('z1 * z1 + z2 * z2', 4)} AS k2, {R('exp(-(z1 * z1 + z2 * z2) / 2)', 8)} AS normality_p FROM a4""",
)
def _(spark, sf):
    d = S.distribution_stats(table(spark, sf, "customer"), "c_acctbal")
    return d.select("n", rnd("k2", 4).alias("k2"), rnd("normality_p", 8).alias("normality_p"))


QQ = [(i + 0.5) / 100 for i in range(100)]


@query(
    "sta_11_qq_points",
    "SELECT " + R("p", 4) + " AS prob, " + R("t", 8) + " AS theoretical, " + R("s", 7) + " AS sample FROM (SELECT unnest(" + repr([float(p) for p in QQ]) + ") AS p, "
    + "unnest(" + repr([normal_quantile(p) for p in QQ]) + ") AS t, unnest(quantile_cont(o_totalprice, " + repr([float(p) for p in QQ]) + ")) AS s FROM orders)",
)
def _(spark, sf):
    q = S.qq_points(table(spark, sf, "orders"), "o_totalprice", 100)
    return q.select(rnd("prob", 4).alias("prob"), rnd("theoretical", 8).alias("theoretical"), rnd("sample", 7).alias("sample"))


@query(
    "sta_13_vif",
    f"""SELECT f AS feature, {R('1 / (1 - r * r)', 8)} AS vif FROM (SELECT corr(l_quantity, l_quantity * l_tax) AS r FROM lineitem),
        (VALUES ('l_quantity'), ('qt')) t(f)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") * F.col("l_tax")).alias("qt"))
    v = S.vif(gram(li, ["l_quantity", "qt"]), ["l_quantity", "qt"])
    return spark.createDataFrame(list(v.items()), "feature string, vif double").withColumn("vif", rnd("vif", 8))


@query(
    "sta_14_concordance",
    f"""WITH p AS (SELECT l_extendedprice AS y, l_extendedprice * 0.9 + l_quantity * 100 AS f FROM lineitem)
        SELECT {R('2 * covar_pop(y, f) / (var_pop(y) + var_pop(f) + (avg(y) - avg(f)) ** 2)', 9)} AS ccc_pop,
        {R('2 * covar_samp(y, f) / (var_samp(y) + var_samp(f) + (avg(y) - avg(f)) ** 2)', 9)} AS ccc_sample FROM p""",
)
def _(spark, sf):
    y, f = F.col("l_extendedprice"), F.col("l_extendedprice") * 0.9 + F.col("l_quantity") * 100
    d = table(spark, sf, "lineitem").select(y.alias("y"), f.alias("f"))
    return d.agg(
        rnd(S.concordance(F.col("y"), F.col("f")), 9).alias("ccc_pop"), rnd(S.concordance(F.col("y"), F.col("f"), True), 9).alias("ccc_sample")
    )


# ------------------------------------------------------------------ order-dependent operators


@query("win_01_global_rank", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def _(spark, sf):
    return O.with_global_index(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


GAPS = "gaps AS (SELECT event_id, ts, user_id, CASE WHEN event_type IN ('click', 'error') THEN value END AS v FROM events)"


def _gaps(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_type").isin("click", "error"), F.col("value")).alias("v")
    )


@query("win_02_forward_fill", f"WITH {GAPS} SELECT event_id, v, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id) AS filled FROM gaps")
def _(spark, sf):
    return O.forward_fill(_gaps(spark, sf), ["ts", "event_id"], "v", "filled").select("event_id", "v", "filled")


@query(
    "win_02_forward_fill_by",
    f"WITH {GAPS} SELECT event_id, user_id, v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS filled FROM gaps",
)
def _(spark, sf):
    return O.forward_fill(_gaps(spark, sf), ["ts", "event_id"], "v", "filled", by="user_id").select("event_id", "user_id", "v", "filled")


@query(
    "win_05_durbin_watson",
    f"""WITH e AS (SELECT value - avg(value) OVER () AS e, ts, event_id FROM events),
        l AS (SELECT e, e - lag(e) OVER (ORDER BY ts, event_id) AS d FROM e)
        SELECT {R('sum(d * d) / sum(e * e)', 8)} AS durbin_watson, count(*) AS n FROM l""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    mean = ev.agg(F.avg("value")).first()[0]
    d = O.durbin_watson(ev.select("ts", "event_id", (F.col("value") - F.lit(mean)).alias("e")), ["ts", "event_id"], "e")
    return d.withColumn("durbin_watson", rnd("durbin_watson", 8))


@query(
    "sta_02_group_p_values",
    f"""WITH g AS (SELECT l_orderkey, count(*) AS n, corr(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6 AND var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0),
        t AS (SELECT *, n - 2 AS df, CASE WHEN abs(r) >= 1 THEN pi() / 2 ELSE atan(abs(r) / sqrt(1 - r * r)) END AS a FROM g)
        SELECT l_orderkey, n, {R('r', 8)} AS correlation, {R("CASE df WHEN 1 THEN 1 - 2 / pi() * a WHEN 2 THEN 1 - abs(r) WHEN 3 THEN 1 - 2 / pi() * (a + sin(a) * cos(a)) ELSE 1 - abs(r) * (3 - r * r) / 2 END", 6)} AS p_value FROM t""",
)
def _(spark, sf):
    """Correlation and p-value per order; for one to four degrees of freedom the distribution has a closed form."""
    g = S.correlation_by_group(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice").where("n BETWEEN 3 AND 6 AND correlation IS NOT NULL")
    return g.select("l_orderkey", "n", rnd("correlation", 8).alias("correlation"), rnd("p_value", 6).alias("p_value"))
