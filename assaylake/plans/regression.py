"""Least-squares, validation, applicability-domain and component-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.columns import rnd
from assaylake.operators import clean as C
from assaylake.operators import pca as PC
from assaylake.operators import pcr as PR
from assaylake.operators import regress as G
from assaylake.operators import split as P
from assaylake.operators.gram import gram, gram_by
from assaylake.operators.ordered import durbin_watson
from assaylake.plans.registry import query, sql_round as R
from assaylake.plans.statistics import EMB, embedding_columns
from assaylake.sources.tables import table

LROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]  # unique in every size
X = ["l_quantity", "l_discount"]

# The charge depends on both features, so the fit has something to find.
CHARGE = "l_extendedprice * (1 - l_discount) / 1000 + l_quantity"
BASE = f"base AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity AS a, l_discount AS b, {CHARGE} AS y FROM lineitem)"
SPLIT = """hs AS (SELECT *, md5('42|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_extendedprice) AS h,
  count(*) OVER () AS n FROM base),
  sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY h) <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM hs)"""


def charges(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*LROW, *X, (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000 + F.col("l_quantity")).alias("y"))


def split_charges(spark, sf):
    return P.random_split(charges(spark, sf), LROW, 0.2)


def ols_sql(source: str, where: str = "") -> str:
    """Two-feature OLS of y on a, b by determinants; gives one row ``fit``."""
    return f"""mo AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb,
  covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, var_pop(y) * count(*) AS syy FROM {source} {where}),
  co AS (SELECT *, saa * sbb - sab * sab AS det FROM mo),
  cf AS (SELECT *, (say * sbb - sby * sab) / det AS c1, (sby * saa - say * sab) / det AS c2 FROM co),
  fit AS (SELECT *, my - c1 * ma - c2 * mb AS c0, syy - c1 * say - c2 * sby AS sse FROM cf)"""


@query(
    "reg_01_ols",
    f"""WITH {BASE}, {ols_sql('base')}, v AS (SELECT *, sse / (n - 3) AS s2 FROM fit),
        t AS (SELECT 'const' AS term, c0 AS c, sqrt(s2 * (1 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS se FROM v
        UNION ALL SELECT 'l_quantity', c1, sqrt(s2 * sbb / det) FROM v UNION ALL SELECT 'l_discount', c2, sqrt(s2 * saa / det) FROM v)
        SELECT term, {R('c')} AS coefficient, {R('se')} AS std_error, {R('c / se', 4)} AS t FROM t""",
)
def _(spark, sf):
    t = G.fit_ols(charges(spark, sf), "y", X).coefficients(spark)
    return t.select("term", rnd("coefficient").alias("coefficient"), rnd("std_error").alias("std_error"), rnd("t", 4).alias("t"))


@query("reg_01_ols_wide")
def _(spark, sf):
    return G.fit_ols(embedding_columns(spark, sf), "label", EMB).coefficients(spark)


SCORED = f"{BASE}, {SPLIT}, {ols_sql('sp', chr(87) + 'HERE split = ' + chr(39) + 'train' + chr(39))}, sc AS (SELECT sp.*, c0 + c1 * a + c2 * b AS p, y - (c0 + c1 * a + c2 * b) AS e FROM sp, fit)"


@query(
    "reg_02_metrics_by_split",
    f"""WITH {SCORED}, a2 AS (SELECT split, y, p, e FROM sc UNION ALL SELECT 'all', y, p, e FROM sc)
        SELECT split, count(*) AS n, {R('1 - sum(e * e) / (var_pop(y) * count(*))', 8)} AS r2, {R('sqrt(avg(e * e))')} AS rmse, {R('avg(abs(e))')} AS mae FROM a2 GROUP BY split""",
)
def _(spark, sf):
    data = C.tokens_to_null(split_charges(spark, sf))
    # One Gram of the training rows gives the scaling and the fit on scaled features.
    g = gram(data.where("split = 'train'"), [*X, "y"])
    params = C.scaling_from_gram(g, X)
    scaled = g.scaled(X, [a for a, _ in params.values()], [s for _, s in params.values()])
    model = G.solve_ols(scaled, "y", X)
    data = C.apply_scaling(data, params)
    m = G.metrics_by_split(G.predictions(data, model), "y")
    return m.select("split", "n", rnd("r2", 8).alias("r2"), rnd("rmse").alias("rmse"), rnd("mae").alias("mae"))


@query(
    "reg_03_model_statistics",
    f"""WITH {BASE}, {ols_sql('base')}, s AS (SELECT *, 1 - sse / syy AS r2 FROM fit)
        SELECT 'r2' AS metric, {R('r2', 8)} AS value FROM s UNION ALL SELECT 'adj_r2', {R('1 - (1 - r2) * (n - 1) / (n - 3)', 8)} FROM s
        UNION ALL SELECT 'f_stat', {R('(syy - sse) / 2 / (sse / (n - 3))', 3)} FROM s
        UNION ALL SELECT 'aic', {R('n * ln(sse / n) + 6', 3)} FROM s UNION ALL SELECT 'bic', {R('n * ln(sse / n) + 3 * ln(n)', 3)} FROM s""",
)
def _(spark, sf):
    st = G.model_statistics(G.fit_ols(charges(spark, sf), "y", X))
    digits = {"r2": 8, "adj_r2": 8, "f_stat": 3, "aic": 3, "bic": 3}
    return spark.createDataFrame([(k, round(st[k], d) + 0.0) for k, d in digits.items()], "metric string, value double")


def _cv_sql(source: str, k: int) -> str:
    """Held-out R2 and RMSE of ``k`` fits; ``source`` ends in a CTE ``fo`` with a fold column."""
    fits, parts = [], []
    for i in range(k):
        s = ols_sql("fo", f"WHERE fold <> {i}")
        for name in ("mo", "co", "cf", "fit"):
            s = s.replace(f"{name} AS (", f"{name}{i} AS (").replace(f"FROM {name})", f"FROM {name}{i})")
        fits.append(s)
        e = "(y - c0 - c1 * a - c2 * b)"
        parts.append(f"SELECT 1 - sum({e} ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg({e} ** 2)) AS rmse FROM fo, fit{i} WHERE fold = {i}")
    return (
        f"WITH {source}, {', '.join(fits)}, m AS ({' UNION ALL '.join(parts)}) SELECT {R('avg(r2)', 8)} AS r2cv, {R('avg(rmse)', 6)} AS rmse_cv FROM m"
    )


def _cv_row(spark, folds):
    cv = G.cross_validate(folds, "y", X)
    return spark.createDataFrame([(round(cv["r2cv"], 8) + 0.0, round(cv["rmse_cv"], 6) + 0.0)], "r2cv double, rmse_cv double")


@query("reg_04_cross_validation", _cv_sql(f"{BASE}, fo AS (SELECT *, l_linenumber % 3 AS fold FROM base)", 3))
def _(spark, sf):
    data = charges(spark, sf).withColumn("fold", F.col("l_linenumber") % 3)
    return _cv_row(spark, gram_by(data, [*X, "y"], "fold"))


@query(
    "reg_04_cross_validation_kfold",
    _cv_sql(
        f"""{BASE}, hs AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_extendedprice)) - 1 AS rn,
        count(*) OVER () AS n FROM base), fo AS (SELECT * EXCLUDE (n), CASE WHEN rn < (n // 5 + 1) * (n % 5) THEN rn // (n // 5 + 1) ELSE n % 5 + (rn - (n // 5 + 1) * (n % 5)) // (n // 5) END AS fold FROM hs)""", 5,
    ),
)
def _(spark, sf):
    return _cv_row(spark, gram_by(P.kfold(charges(spark, sf), LROW, 5), [*X, "y"], "fold"))


@query(
    "reg_04_external_kfold",
    _cv_sql(
        f"""{BASE}, hs AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_extendedprice)) - 1 AS rn,
        count(*) OVER () AS total FROM base), te AS (SELECT *, count(*) OVER () AS n FROM hs WHERE rn < ceil(total * 0.2 - 1e-9)),
        fo AS (SELECT * EXCLUDE (n, total), CASE WHEN rn < (n // 5 + 1) * (n % 5) THEN rn // (n // 5 + 1) ELSE n % 5 + (rn - (n // 5 + 1) * (n % 5)) // (n // 5) END AS fold FROM te)""", 5,
    ).replace("AS r2cv", "AS q2cv_ext").replace("AS rmse_cv", "AS rmse_cv_ext"),
)
def _(spark, sf):
    """Five-fold validation inside the external set: the rows that a random split puts aside."""
    cv = G.cross_validate_external(split_charges(spark, sf).where("split = 'test'").drop("split"), "y", X, LROW)
    return spark.createDataFrame([(round(cv["q2cv_ext"], 8) + 0.0, round(cv["rmse_cv_ext"], 6) + 0.0)], "q2cv_ext double, rmse_cv_ext double")


LEV = "1 / fit.n + ((a - ma) ** 2 * sbb - 2 * (a - ma) * (b - mb) * sab + (b - mb) ** 2 * saa) / det"


@query(
    "reg_05_leave_one_out",
    f"""WITH {BASE}, {ols_sql('base')}, l AS (SELECT (y - c0 - c1 * a - c2 * b) / (1 - ({LEV})) AS d, syy FROM base, fit)
        SELECT {R('1 - sum(d * d) / any_value(syy)', 8)} AS q2loo, {R('sqrt(avg(d * d))')} AS rmseloo, {R('sum(d * d)', 2)} AS press FROM l""",
)
def _(spark, sf):
    data = charges(spark, sf)
    t = G.leave_one_out(data, G.fit_ols(data, "y", X))
    return t.select(rnd("q2loo", 8).alias("q2loo"), rnd("rmseloo").alias("rmseloo"), rnd("press", 2).alias("press"))


@query(
    "reg_06_external",
    f"""WITH {SCORED} SELECT count(*) AS n, {R('1 - sum(e * e) / sum((y - my) ** 2)', 8)} AS q2_ext,
        {R('2 * covar_samp(y, p) / (var_samp(y) + var_samp(p) + (avg(y) - avg(p)) ** 2)', 8)} AS ccc_ext FROM sc, fit WHERE split = 'test'""",
)
def _(spark, sf):
    data = split_charges(spark, sf)
    model = G.fit_ols(data.where("split = 'train'"), "y", X)
    t = G.external_metrics(G.predictions(data, model), model)
    return t.select("n", rnd("q2_ext", 8).alias("q2_ext"), rnd("ccc_ext", 8).alias("ccc_ext"))


EBASE = "base AS (SELECT event_id, epoch_us(ts) / 3.6e9 - 473352 AS a, (props::JSON ->> '$.k')::DOUBLE AS b, value AS y FROM events)"
ESPLIT = """hs AS (SELECT *, md5('42|' || event_id) AS hash, count(*) OVER () AS n FROM base),
  sp AS (SELECT * EXCLUDE (n), CASE WHEN row_number() OVER (ORDER BY hash) <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM hs)"""
WILLIAMS = f"""{EBASE}, {ESPLIT}, {ols_sql('sp', "WHERE split = 'train'")},
  w0 AS (SELECT sp.*, y - (c0 + c1 * a + c2 * b) AS e, {LEV} AS h, sqrt(sse / (fit.n - 3)) AS s, 9 / fit.n AS hstar FROM sp, fit),
  w AS (SELECT *, e / (s * sqrt(CASE WHEN split = 'train' THEN 1 - h ELSE 1 + h END)) AS r FROM w0)"""


def event_features(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("a"),
        F.get_json_object("props", "$.k").cast("double").alias("b"), F.col("value").alias("y"),
    )


def _williams(spark, sf):
    data = P.random_split(event_features(spark, sf), ["event_id"], 0.2)
    model = G.fit_ols(data.where("split = 'train'"), "y", ["a", "b"])
    return G.williams(data, model), model


@query(
    "reg_07_williams",
    f"WITH {WILLIAMS} SELECT event_id, split, {R('h', 8)} AS leverage, {R('r', 6)} AS std_residual, h < hstar AND abs(r) < 3 AS in_domain FROM w",
)
def _(spark, sf):
    w, _model = _williams(spark, sf)
    return w.select("event_id", "split", rnd("leverage", 8).alias("leverage"), rnd("std_residual", 6).alias("std_residual"), "in_domain")


@query(
    "reg_07_domain_coverage",
    f"""WITH {WILLIAMS} SELECT split, count(*) AS n, {R('100 * avg((h < hstar AND abs(r) < 3)::INT)', 6)} AS coverage_pct,
        count(*) FILTER (WHERE NOT (h < hstar AND abs(r) < 3)) AS n_outliers FROM w GROUP BY split""",
)
def _(spark, sf):
    w, _model = _williams(spark, sf)
    return G.domain_coverage(w).withColumn("coverage_pct", rnd("coverage_pct", 6))


@query(
    "jon_09_outlier_report",
    f"""WITH {WILLIAMS} SELECT event_id, upper(split[1]) || split[2:] AS "WP_Dataset", {R('h', 8)} AS "WP_Leverage", {R('r', 6)} AS "WP_Std_Residual",
        CASE WHEN h >= hstar AND abs(r) >= 3 THEN 'High leverage & outlier' WHEN h >= hstar THEN 'High leverage' ELSE 'Outlier residual' END AS "WP_Reason",
        y, {R('a', 6)} AS a, b FROM w WHERE h >= hstar OR abs(r) >= 3""",
)
def _(spark, sf):
    w, model = _williams(spark, sf)
    rep = G.outlier_report(w, model, ["event_id"])
    return rep.withColumns({"WP_Leverage": rnd("WP_Leverage", 8), "WP_Std_Residual": rnd("WP_Std_Residual", 6), "a": rnd("a", 6)})


@query(
    "reg_08_predictions",
    f"WITH {SCORED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, split, {R('p', 6)} AS prediction, {R('e', 6)} AS residual FROM sc",
)
def _(spark, sf):
    data = split_charges(spark, sf)
    p = G.predictions(data, G.fit_ols(data.where("split = 'train'"), "y", X))
    return p.select(*LROW, "split", rnd("prediction", 6).alias("prediction"), rnd("residual", 6).alias("residual"))


@query(
    "reg_09_coverage_gate",
    f"""WITH {BASE}, {ols_sql('base')}, g AS (SELECT {LEV} AS h, (y - c0 - c1 * a - c2 * b) / sqrt(sse / (fit.n - 3) * (1 - ({LEV}))) AS r, 9 / fit.n AS hstar FROM base, fit)
        SELECT {R('CASE WHEN bool_or(abs(r) >= 3) THEN 0 ELSE 100 * avg((h < hstar)::INT) END', 6)} AS ad_coverage FROM g""",
)
def _(spark, sf):
    data = charges(spark, sf).withColumn("split", F.lit("train"))
    model = G.fit_ols(data, "y", X)
    return G.coverage_gate(G.williams(data, model), model).withColumn("ad_coverage", rnd("ad_coverage", 6))


@query(
    "prj_03_linear_formula",
    f"SELECT p_partkey, {R('1.25 + 0.5 * p_size - 0.003 * p_retailprice', 8)} AS predicted FROM part",
)
def _(spark, sf):
    p = G.apply_formula(table(spark, sf, "part"), {"p_size": 0.5, "p_retailprice": -0.003}, 1.25, "predicted")
    return p.select("p_partkey", rnd("predicted", 8).alias("predicted"))


@query(
    "win_05_residual_durbin_watson",
    f"""WITH base AS (SELECT event_id, ts, epoch_us(ts) / 3.6e9 - 473352 AS a, (props::JSON ->> '$.k')::DOUBLE AS b, value AS y FROM events), {ols_sql('base')},
        r AS (SELECT ts, event_id, y - c0 - c1 * a - c2 * b AS e FROM base, fit), l AS (SELECT e, e - lag(e) OVER (ORDER BY ts, event_id) AS d FROM r)
        SELECT {R('sum(d * d) / sum(e * e)', 6)} AS durbin_watson, count(*) AS n FROM l""",
)
def _(spark, sf):
    ev = event_features(spark, sf)
    model = G.fit_ols(ev, "y", ["a", "b"])
    d = durbin_watson(G.predictions(ev, model), ["ts", "event_id"], "residual")
    return d.withColumn("durbin_watson", rnd("durbin_watson", 6))


# ------------------------------------------------------------------ principal components
# Two standardised columns: eigenvalues (1 +- r) n / (n - 1), axes (1, +-1) / sqrt 2.

PXY = "SELECT p_partkey, p_retailprice AS u, p_retailprice + 40 * p_size AS v FROM part"
PMO = f"pxy AS ({PXY}), pm AS (SELECT count(*)::DOUBLE AS n, corr(u, v) AS r, avg(u) AS mu, avg(v) AS mv, stddev_pop(u) AS su, stddev_pop(v) AS sv FROM pxy)"


def part_xy(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("u"), (F.col("p_retailprice") + 40 * F.col("p_size")).alias("v")
    )


@query(
    "pca_01_variance",
    f"""WITH {PMO}, c AS (SELECT 1 AS component, (1 + r) * n / (n - 1) AS e, 50 * (1 + r) AS s, 50 * (1 + r) AS t FROM pm
        UNION ALL SELECT 2, (1 - r) * n / (n - 1), 50 * (1 - r), 100 FROM pm)
        SELECT component, {R('e', 8)} AS eigenvalue, {R('s')} AS explained_pct, {R('t')} AS cumulative_pct FROM c""",
)
def _(spark, sf):
    t = PC.fit_pca(part_xy(spark, sf), ["u", "v"]).variance_table(spark)
    return t.select("component", rnd("eigenvalue", 8).alias("eigenvalue"), rnd("explained_pct").alias("explained_pct"), rnd("cumulative_pct").alias("cumulative_pct"))


@query(
    "pca_01_scores",
    f"""WITH {PMO} SELECT p_partkey, {R('((u - mu) / su + (v - mv) / sv) / sqrt(2)', 7)} AS "PC1", {R('abs((u - mu) / su - (v - mv) / sv) / sqrt(2)', 7)} AS pc2_size FROM pxy, pm""",
)
def _(spark, sf):
    df = part_xy(spark, sf)
    s = PC.project(df, PC.fit_pca(df, ["u", "v"]), ["p_partkey"])
    return s.select("p_partkey", rnd("PC1", 7).alias("PC1"), rnd(F.abs("PC2"), 7).alias("pc2_size"))


@query("pca_01_variance_wide")
def _(spark, sf):
    return PC.fit_pca(embedding_columns(spark, sf), EMB).variance_table(spark)


@query(
    "pca_02_loadings",
    f"""WITH {PMO} SELECT f AS feature, k AS component, {R('CASE WHEN k = 1 THEN sqrt((1 + r) / 2) ELSE sqrt((1 - r) / 2) END', 8)} AS abs_loading
        FROM pm, (VALUES ('u'), ('v')) t(f), (VALUES (1), (2)) s(k)""",
)
def _(spark, sf):
    l = PC.fit_pca(part_xy(spark, sf), ["u", "v"]).loading_rows(spark)
    return l.select("feature", "component", rnd(F.abs("loading"), 8).alias("abs_loading"))


@query(
    "pca_03_mean_filled",
    f"""WITH pxy AS (SELECT p_retailprice AS u0, CASE WHEN p_size > 5 THEN p_retailprice + 40 * p_size END AS v0 FROM part),
        f AS (SELECT u0 AS u, coalesce(v0, (SELECT avg(v0) FROM pxy)) AS v FROM pxy), pm AS (SELECT count(*)::DOUBLE AS n, corr(u, v) AS r FROM f)
        SELECT k AS component, {R('least(1, sqrt((CASE WHEN k = 1 THEN 1 + r ELSE 1 - r END) * n / (n - 1) / 2))', 8)} AS abs_loading, 2::BIGINT AS n_features FROM pm, (VALUES (1), (2)) s(k)""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_retailprice").alias("u"), F.when(F.col("p_size") > 5, F.col("p_retailprice") + 40 * F.col("p_size")).alias("v")
    )
    l = PC.fit_pca(p, ["u", "v"], na_policy="mean").loading_rows(spark, "covariance")
    return l.groupBy("component").agg(rnd(F.max(F.abs("loading")), 8).alias("abs_loading"), F.count(F.lit(1)).alias("n_features"))


def _loadings(spark, sf):
    """A loading-shaped table derived from ``lineitem``: r of each measure with each ship month."""
    li = table(spark, sf, "lineitem").withColumn("component", F.month("l_shipdate").cast("int"))
    r = lambda c: F.regr_sxy("l_extendedprice", c) / F.sqrt(F.regr_sxx("l_extendedprice", c) * F.regr_syy("l_extendedprice", c))
    wide = li.groupBy("component").agg(*[r(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return wide.unpivot(["component"], ["l_quantity", "l_discount", "l_tax"], "feature", "loading").withColumn("loading", F.col("loading") * 10)


LOADINGS = """ld AS (SELECT component, feature, loading FROM (
  SELECT month(l_shipdate)::INT AS component, 10 * corr(l_extendedprice, l_quantity) AS l_quantity, 10 * corr(l_extendedprice, l_discount) AS l_discount,
  10 * corr(l_extendedprice, l_tax) AS l_tax FROM lineitem GROUP BY 1) UNPIVOT (loading FOR feature IN (l_quantity, l_discount, l_tax)))"""


@query(
    "pca_04_importance",
    f"WITH {LOADINGS} SELECT feature, {R('max(abs(loading))', 7)} AS importance, row_number() OVER (ORDER BY max(abs(loading)) DESC, feature)::INT AS rank FROM ld GROUP BY feature",
)
def _(spark, sf):
    return PC.importance(_loadings(spark, sf)).withColumn("importance", rnd("importance", 7))


@query(
    "srt_02_top_per_component",
    f"""WITH {LOADINGS} SELECT DISTINCT feature FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS rn FROM ld WHERE component IN (1, 2, 3)) WHERE rn <= 1""",
)
def _(spark, sf):
    return PC.top_per_component(_loadings(spark, sf), [1, 2, 3], 1)


@query("pca_04_threshold", f"WITH {LOADINGS} SELECT DISTINCT feature FROM ld WHERE abs(loading) >= 0.3")
def _(spark, sf):
    return PC.above_threshold(_loadings(spark, sf), 0.3)


@query(
    "srt_03_top_loadings",
    f"WITH {LOADINGS} SELECT feature, {R('sum(abs(loading))', 7)} AS strength FROM ld WHERE component IN (1, 2) GROUP BY feature ORDER BY sum(abs(loading)) DESC LIMIT 2",
)
def _(spark, sf):
    return PC.top_loadings(_loadings(spark, sf), [1, 2], 2).withColumn("strength", rnd("strength", 7))


@query(
    "srt_04_biplot_arrows",
    f"""WITH {LOADINGS}, w AS (SELECT feature, max(loading) FILTER (WHERE component = 1) AS lx, max(loading) FILTER (WHERE component = 2) AS ly FROM ld GROUP BY 1)
        SELECT feature, {R('lx', 7)} AS lx, {R('ly', 7)} AS ly, {R('sqrt(lx * lx + ly * ly)', 7)} AS magnitude FROM w ORDER BY sqrt(lx * lx + ly * ly) DESC LIMIT 2""",
)
def _(spark, sf):
    a = PC.biplot_arrows(_loadings(spark, sf), 1, 2, 2)
    return a.select("feature", *[rnd(c, 7).alias(c) for c in ("lx", "ly", "magnitude")])


@query(
    "pca_05_feature_report",
    f"""WITH {LOADINGS}, i AS (SELECT feature, max(abs(loading)) AS m, row_number() OVER (ORDER BY max(abs(loading)) DESC, feature)::INT AS rank FROM ld GROUP BY 1),
        b AS (SELECT feature, arg_max(component, abs(loading)) AS c, arg_max(loading, abs(loading)) AS l,
        coalesce(string_agg('PC' || component || ':' || printf('%.3f', abs(loading)), '; ' ORDER BY component) FILTER (WHERE abs(loading) >= 0.3), '') AS reason FROM ld GROUP BY 1)
        SELECT feature, rank, {R('m', 7)} AS importance, {R('m', 7)} AS max_abs_loading, 'PC' || c AS max_loading_pc, {R('l', 7)} AS max_loading_value, reason AS selection_reason FROM i JOIN b USING (feature)""",
)
def _(spark, sf):
    r = PC.feature_report(_loadings(spark, sf))
    return r.withColumns({c: rnd(c, 7) for c in ("importance", "max_abs_loading", "max_loading_value")})


@query("win_03_cumulative_variance", f"WITH {PMO} SELECT 1 AS component, {R('50 * (1 + r)')} AS cumulative_pct FROM pm UNION ALL SELECT 2, 100.0::DOUBLE FROM pm")
def _(spark, sf):
    t = PC.fit_pca(part_xy(spark, sf), ["u", "v"]).variance_table(spark)
    return t.select("component", rnd("cumulative_pct").alias("cumulative_pct"))


@query("pca_06_refit", f"WITH {PMO} SELECT 1 AS component, {R('(1 + r) * n / (n - 1)', 8)} AS eigenvalue FROM pm UNION ALL SELECT 2, {R('(1 - r) * n / (n - 1)', 8)} FROM pm")
def _(spark, sf):
    df = part_xy(spark, sf).withColumn("w", F.col("p_partkey").cast("double") % 17)
    t = PC.refit(PC.fit_pca(df, ["u", "v", "w"]), ["u", "v"]).variance_table(spark)
    return t.select("component", rnd("eigenvalue", 8).alias("eigenvalue"))


@query(
    "pca_07_project_new",
    f"""WITH {PMO} SELECT s_suppkey, {R('((s_acctbal - mu) / su + (s_nationkey * 100 - mv) / sv) / sqrt(2)', 6)} AS "PC1" FROM supplier, pm""",
)
def _(spark, sf):
    model = PC.load_pca(PC.fit_pca(part_xy(spark, sf), ["u", "v"], n_components=1).model_rows(spark))
    new = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("u"), (F.col("s_nationkey") * 100.0).alias("v"))
    return PC.project(new, model, ["s_suppkey"]).withColumn("PC1", rnd("PC1", 6))


def _pcr_sql():
    """One component kept of two: y on PC1 of the standardised features, fitted on the training part."""
    train = "p_partkey % 4 <> 0"
    return f"""WITH d AS (SELECT p_partkey, p_retailprice AS u, p_retailprice + 40 * p_size AS v, p_size * 1.5 + p_retailprice / 100 AS y, {train} AS tr FROM part),
      m AS (SELECT avg(u) AS mu, avg(v) AS mv, stddev_pop(u) AS su, stddev_pop(v) AS sv FROM d WHERE tr),
      s AS (SELECT p_partkey, tr, y, ((u - mu) / su + (v - mv) / sv) / sqrt(2) AS z FROM d, m),
      f AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM s WHERE tr), p AS (SELECT s.*, a + b * z AS p FROM s, f)
      SELECT CASE WHEN tr THEN 'train' ELSE 'test' END AS split, count(*) AS n, {R('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 8)} AS r2,
      {R('sqrt(avg((y - p) ** 2))', 7)} AS rmse, {R('avg(abs(y - p))', 7)} AS mae FROM p GROUP BY 1"""


@query("reg_10_pcr", _pcr_sql())
def _(spark, sf):
    d = table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("u"), (F.col("p_retailprice") + 40 * F.col("p_size")).alias("v"),
        (F.col("p_size") * 1.5 + F.col("p_retailprice") / 100).alias("y"),
        F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("train").alias("split"),
        (F.col("p_partkey") % 5).alias("fold"),
    )
    model = PR.fit_pcr(d.where("split = 'train'"), "y", ["u", "v"], "fold", n_components=1)
    m = G.metrics_by_split(PR.pcr_scored(d, model), "y").where("split <> 'all'")
    return m.select("split", "n", rnd("r2", 8).alias("r2"), rnd("rmse", 7).alias("rmse"), rnd("mae", 7).alias("mae"))


@query("reg_10_pcr_optimised")
def _(spark, sf):
    d = P.kfold(embedding_columns(spark, sf), ["vec_id"], 5)
    model = PR.fit_pcr(d, "label", EMB, "fold", optimise=True)
    return model.coefficients(spark)



@query(
    "win_04_importance_rank",
    f"WITH {LOADINGS} SELECT feature, row_number() OVER (ORDER BY max(abs(loading)) DESC, feature)::INT AS rank FROM ld GROUP BY feature",
)
def _(spark, sf):
    return PC.importance(_loadings(spark, sf)).select("feature", "rank")
