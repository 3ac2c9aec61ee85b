"""Describe, profile and count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.columns import rnd
from assaylake.operators import clean as C
from assaylake.operators import profile as P
from assaylake.plans.cleaning import HOLEY, MEASURES, holey
from assaylake.plans.registry import query, sql_round as R
from assaylake.sources.tables import table


def _describe_sql():
    parts = [
        f"SELECT '{c}' AS \"column\", count({c}) AS count, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, "
        f"min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM holey"
        for c in MEASURES
    ]
    return f"WITH {HOLEY} " + " UNION ALL ".join(parts)


@query("agg_01_describe", _describe_sql())
def _(spark, sf):
    d = P.describe(holey(spark, sf), MEASURES)
    return d.withColumns({"mean": rnd("mean"), "std": rnd("std")})


@query("agg_02_dimensions", "SELECT count(*) AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def _(spark, sf):
    return P.dimensions(table(spark, sf, "lineitem"))


def _max_corr_sql(cols, rel):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return "greatest(" + ", ".join(f"abs(corr({a}, {b}))" for a, b in pairs) + f") FROM {rel}"


@query(
    "agg_03_profile",
    f"""WITH m AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem)
        SELECT count(*) AS no_of_rows, 5::BIGINT AS no_of_cols, 0::BIGINT AS missing_values, 4::BIGINT AS numeric_cols,
        least(var_samp(l_quantity), var_samp(l_extendedprice), var_samp(l_discount), var_samp(l_tax)) < 0.01 AS has_low_variance,
        {R('(SELECT ' + _max_corr_sql(MEASURES, 'm') + ')')} AS max_correlation FROM m""",
)
def _(spark, sf):
    d = P.dataset_profile(table(spark, sf, "lineitem").select(*MEASURES, "l_returnflag"))
    return d.withColumn("max_correlation", rnd("max_correlation"))


@query(
    "agg_05_group_means",
    f"SELECT p_brand, {R('avg(p_size)')} AS p_size, {R('avg(p_retailprice)', 4)} AS p_retailprice FROM part GROUP BY p_brand",
)
def _(spark, sf):
    g = P.group_means(table(spark, sf, "part"), "p_brand", ["p_size", "p_retailprice"])
    return g.select("p_brand", rnd("p_size").alias("p_size"), rnd("p_retailprice", 4).alias("p_retailprice"))


@query(
    "agg_06_group_mode",
    """SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) rn
       FROM events GROUP BY user_id, event_type) WHERE rn = 1""",
)
def _(spark, sf):
    return P.group_mode(table(spark, sf, "events"), "user_id", "event_type")


@query("agg_07_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def _(spark, sf):
    return P.value_counts(table(spark, sf, "part"), "p_type")


@query("agg_08_crosstab", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return P.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("agg_09_categories", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS category FROM part")
def _(spark, sf):
    return P.categories(table(spark, sf, "part"), "p_size")


@query(
    "agg_11_prediction_summary",
    f"""WITH p AS (SELECT 100 + 2.5 * l_quantity - 30 * l_discount AS y FROM lineitem)
        SELECT count(*) AS n, {R('avg(y)')} AS mean, {R('stddev_pop(y)')} AS std, {R('min(y)')} AS min, {R('max(y)')} AS max FROM p""",
)
def _(spark, sf):
    y = 100 + 2.5 * F.col("l_quantity") - 30 * F.col("l_discount")
    s = P.prediction_summary(table(spark, sf, "lineitem").select(y.alias("y")), "y")
    return s.select("n", *[rnd(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "sta_10_histogram",
    f"""WITH b AS (SELECT min(value) lo, max(value) hi FROM events)
        SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n,
        {R('any_value(lo) + any_value(least(floor((value - lo) / ((hi - lo) / 30)), 29)) * any_value((hi - lo) / 30)')} AS bin_start
        FROM events, b GROUP BY 1, 2""",
)
def _(spark, sf):
    h = P.histogram(table(spark, sf, "events"), "value", 30, by="event_type")
    return h.withColumn("bin_start", rnd("bin_start"))


@query(
    "sta_12_box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) q3 FROM events GROUP BY 1)
       SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
       FROM events JOIN q USING (event_type) GROUP BY event_type, q.q1, q.median, q.q3""",
)
def _(spark, sf):
    b = C.box_stats(table(spark, sf, "events"), "event_type", "value")
    return b.withColumns({c: rnd(c) for c in ("q1", "median", "q3")})


@query("srt_01_head", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 20")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.orderBy("l_orderkey", "l_linenumber", "l_extendedprice").limit(20).select(*li.columns[0:1], "l_linenumber", "l_quantity")
