"""Column, row, missing-value and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.columns import rnd
from assaylake.operators import clean as C
from assaylake.plans.registry import query, sql_round as R
from assaylake.sources.tables import table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LKEY = ["l_orderkey", "l_linenumber"]


def holey(spark, sf):
    """``lineitem`` measures with nulls where discount or tax is zero."""
    li = table(spark, sf, "lineitem")
    return li.select(
        *LKEY, "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
        "l_returnflag",
    )


HOLEY = """holey AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag FROM lineitem)"""


# ---------------------------------------------------------------- columns


@query("prj_01_drop_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def _(spark, sf):
    return C.drop_columns(table(spark, sf, "part"), ["p_name", "p_type", "p_retailprice"])


@query("prj_02_rename_columns", "SELECT c_custkey AS id, c_name AS compound, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def _(spark, sf):
    return C.rename_columns(
        table(spark, sf, "customer"),
        {"c_custkey": " id ", "c_name": "compound", "c_acctbal": "balance", "c_mktsegment": "", "c_nationkey": "c_nationkey"},
    )


@query("prj_04_numeric_complete", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def _(spark, sf):
    return C.numeric_complete(holey(spark, sf))


def _groups(spark, sf):
    """A column-group table derived from ``part``: the brand decides the group of each size column."""
    return table(spark, sf, "part").select(
        (F.col("p_size") % 3).cast("string").alias("group_id"),
        F.col("p_size").alias("item_no"),
        F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("descriptor"),
    ).distinct()


SIZES = range(1, 51)


def _size_table(spark, sf, sizes=SIZES):
    part = table(spark, sf, "part")
    return part.groupBy("p_brand").pivot("p_size", list(sizes)).agg(F.sum("p_retailprice")).select(
        "p_brand", *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"size_{i}") for i in sizes]
    )


KEPT_SIZES = [i for i in SIZES if i % 3 == 1]


@query(
    "prj_05_keep_groups",
    "SELECT p_brand, " + ", ".join(f"{R(f'coalesce(sum(p_retailprice) FILTER (WHERE p_size = {i}), 0)', 2)} AS size_{i}" for i in KEPT_SIZES) + " FROM part GROUP BY p_brand",
)
def _(spark, sf):
    out = C.keep_groups(_size_table(spark, sf), _groups(spark, sf), ["1"])
    return out.select("p_brand", *[rnd(c, 2).alias(c) for c in out.columns if c != "p_brand"])


@query(
    "prj_06_group_features",
    """WITH g AS (SELECT DISTINCT p_size % 3 AS gid, p_size FROM part WHERE p_size % 3 IN (0, 2))
       SELECT 'size_' || p_size AS feature, p_size <= 45 AS available FROM g""",
)
def _(spark, sf):
    """The table has sizes up to 45, so five sizes of the groups are missing."""
    present, missing = C.features_of_groups(_size_table(spark, sf, range(1, 46)), _groups(spark, sf), ["2", "0"])
    return spark.createDataFrame([(c, True) for c in present] + [(c, False) for c in missing], "feature string, available boolean")


@query("prj_07_drop_constant", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *LKEY, "l_quantity", F.lit(1.0).alias("fixed"), F.lit(None).cast("double").alias("empty")
    )
    return C.drop_constant(li)


@query("prj_08_drop_low_variance", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _(spark, sf):
    return C.drop_low_variance(table(spark, sf, "lineitem").select(*LKEY, *MEASURES, "l_returnflag"), 0.01)


@query(
    "prj_09_drop_zero_variance",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *LKEY, *MEASURES, F.lit(7.0).alias("fixed"), (F.col("l_tax") * 1e-3).alias("tiny")
    )
    return C.drop_zero_variance(li, population_threshold=1e-6)


@query(
    "prj_10_drop_correlated",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *LKEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"),
    )
    return C.drop_correlated(li, 0.9)


@query("prj_11_report_order", f"SELECT c_custkey AS id, {R('c_acctbal * 2', 4)} AS prediction, c_acctbal, c_name, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id").withColumn("prediction", rnd(F.col("c_acctbal") * 2, 4))
    return C.report_order(df, ["prediction"], ["c_acctbal"])


# ---------------------------------------------------------------- rows


@query("flt_01_delete_rows", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return C.delete_rows(table(spark, sf, "orders"), gone, ["o_custkey"])


@query("flt_02_drop_null_rows", f"WITH {HOLEY} SELECT * FROM holey WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
def _(spark, sf):
    return C.drop_rows_with_nulls(holey(spark, sf))


@query("flt_02_drop_null_columns", f"WITH {HOLEY} SELECT * EXCLUDE (l_discount, l_tax) FROM holey")
def _(spark, sf):
    return C.drop_columns_with_nulls(holey(spark, sf))


@query(
    "flt_03_outliers_iqr",
    """WITH b AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events)
       SELECT event_id, user_id, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier
       FROM events, b""",
)
def _(spark, sf):
    return C.outlier_flag(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", "iqr", 1.5)


@query(
    "flt_04_outliers_zscore",
    """WITH b AS (SELECT avg(value) m, stddev_pop(value) s FROM events)
       SELECT event_id, value, abs(value - m) > 3 * s AS is_outlier FROM events, b""",
)
def _(spark, sf):
    return C.outlier_flag(table(spark, sf, "events").select("event_id", "value"), "value", "zscore", 3.0)


@query(
    "flt_05_outliers_by_split",
    """WITH s AS (SELECT event_id, value, CASE WHEN event_type = 'error' THEN 'test' ELSE 'train' END AS split FROM events),
       b AS (SELECT split, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM s GROUP BY split)
       SELECT event_id, value, s.split, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier
       FROM s JOIN b USING (split)""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "value", F.when(F.col("event_type") == "error", "test").otherwise("train").alias("split")
    )
    return C.outlier_flag_by(ev, "value", "split")


@query("flt_08_section", "SELECT * FROM documents WHERE lang = 'fr'")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang") == "fr")


# ---------------------------------------------------------------- missing values


@query(
    "sca_03_tokens_to_null",
    """WITH t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'n/a' WHEN '1-URGENT' THEN 'NaN' ELSE o_orderpriority END AS p FROM orders)
       SELECT o_orderkey, CASE WHEN p IN ('na','NA','n/a','','null','NULL','None','nan','NaN') THEN NULL ELSE p END AS p FROM t""",
)
def _(spark, sf):
    p = F.col("o_orderpriority")
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(p == "5-LOW", "n/a").when(p == "1-URGENT", "NaN").otherwise(p).alias("p")
    )
    return C.tokens_to_null(df)


@query("sca_04_fill_constant", f"WITH {HOLEY} SELECT * REPLACE (coalesce(l_discount, -1.0::DOUBLE) AS l_discount, coalesce(l_tax, -1.0::DOUBLE) AS l_tax) FROM holey")
def _(spark, sf):
    return C.fill_constant(holey(spark, sf), -1.0)


@query(
    "sca_05_fill_mean",
    f"WITH {HOLEY} SELECT l_orderkey, l_linenumber, {R('coalesce(l_discount, (SELECT avg(l_discount) FROM holey))')} AS l_discount, "
    f"{R('coalesce(l_tax, (SELECT avg(l_tax) FROM holey))')} AS l_tax FROM holey",
)
def _(spark, sf):
    df = C.fill_mean(holey(spark, sf), ["l_discount", "l_tax"])
    return df.select(*LKEY, rnd("l_discount").alias("l_discount"), rnd("l_tax").alias("l_tax"))


@query(
    "sca_05_fill_median",
    f"WITH {HOLEY} SELECT l_orderkey, l_linenumber, {R('coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM holey))')} AS l_discount, "
    f"{R('coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM holey))')} AS l_tax FROM holey",
)
def _(spark, sf):
    df = C.fill_median(holey(spark, sf), ["l_discount", "l_tax"])
    return df.select(*LKEY, rnd("l_discount").alias("l_discount"), rnd("l_tax").alias("l_tax"))


MODE_SQL = "(SELECT {c} FROM holey WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "sca_06_fill_mode",
    f"WITH {HOLEY} SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, "
    f"coalesce(l_discount, {MODE_SQL.format(c='l_discount')}) AS l_discount, coalesce(l_tax, {MODE_SQL.format(c='l_tax')}) AS l_tax FROM holey",
)
def _(spark, sf):
    return C.fill_mode(holey(spark, sf), ["l_discount", "l_tax", "l_returnflag"])


@query(
    "sca_07_column_imputation",
    f"""WITH {HOLEY}, h AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag, CASE WHEN l_quantity % 3 = 0 THEN NULL ELSE l_quantity END AS q,
            CASE WHEN l_quantity % 4 = 0 THEN NULL ELSE l_extendedprice END AS price, CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE l_returnflag END AS word FROM holey),
        m AS (SELECT flag FROM h WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)
        SELECT l_orderkey, l_linenumber, l_extendedprice, {R('coalesce(l_tax, (SELECT avg(l_tax) FROM h))')} AS l_tax, {R('coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM h))')} AS l_discount,
        coalesce(flag, (SELECT flag FROM m)) AS flag, last_value(q IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING) AS q,
        coalesce(price, -1.5) AS price, coalesce(word, '0') AS word FROM h""",
)
def _(spark, sf):
    """Every way of filling, one column each: mean, median, mode, forward fill in row order, a number, and a number in a text column."""
    q = F.col("l_quantity")
    h = holey(spark, sf).withColumns({
        "flag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "q": F.when(q % 3 != 0, q), "price": F.when(q % 4 != 0, F.col("l_extendedprice")), "word": F.when(q % 5 != 0, F.col("l_returnflag")),
    })
    how = {"l_tax": "mean", "l_discount": "median", "flag": "mode", "q": "ffill", "price": -1.5, "word": 0}
    h = C.impute(h, how, ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return h.select(*LKEY, "l_extendedprice", rnd("l_tax").alias("l_tax"), rnd("l_discount").alias("l_discount"), "flag", "q", "price", "word")


@query(
    "agg_04_cleaning_report",
    f"""WITH {HOLEY}, b AS (SELECT count(*) AS r, sum((l_discount IS NULL)::INT + (l_tax IS NULL)::INT) AS m FROM holey),
        a AS (SELECT count(*) AS r FROM holey WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL)
        SELECT b.r AS rows_before, 7::BIGINT AS cols_before, b.m::BIGINT AS missing_before, a.r AS rows_after, 7::BIGINT AS cols_after,
        0::BIGINT AS missing_after, b.r - a.r AS rows_removed, 0::BIGINT AS cols_removed, b.m::BIGINT AS missing_filled FROM a, b""",
)
def _(spark, sf):
    h = holey(spark, sf)
    return C.cleaning_report(h, C.drop_rows_with_nulls(h))


# ---------------------------------------------------------------- scaling and transforms


def _scaled(method):
    def run(spark, sf):
        li = table(spark, sf, "lineitem").select(*LKEY, *MEASURES, F.lit(3.0).alias("fixed"))
        df = C.scale(li, method, MEASURES + ["fixed"])
        return df.select(*LKEY, *[rnd(c, 7).alias(c) for c in MEASURES + ["fixed"]])

    return run


def _scaled_sql(loc, spread):
    cols = ", ".join(
        R(f"(l.{c} - p.a_{c}) / coalesce(nullif(p.s_{c}, 0), 1)", 7) + f" AS {c}" for c in MEASURES
    )
    params = ", ".join(f"{loc.format(c=c)} AS a_{c}, {spread.format(c=c)} AS s_{c}" for c in MEASURES)
    return f"WITH p AS (SELECT {params} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols}, 0.0::DOUBLE AS fixed FROM lineitem l, p"


query("sca_08_scale_standard", _scaled_sql("avg({c})", "stddev_pop({c})"))(_scaled("standard"))
query("sca_09_scale_minmax", _scaled_sql("min({c})", "max({c}) - min({c})"))(_scaled("minmax"))
query("sca_10_scale_robust", _scaled_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))(_scaled("robust"))


@query(
    "sca_11_scale_on_train",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'train' END AS split FROM lineitem),
        p AS (SELECT avg(l_quantity) aq, stddev_pop(l_quantity) sq, avg(l_tax) atx, stddev_pop(l_tax) st FROM s WHERE split = 'train')
        SELECT l_orderkey, l_linenumber, split, {R('(l_quantity - aq) / sq', 7)} AS l_quantity, {R('(l_tax - atx) / st', 7)} AS l_tax FROM s, p""",
)
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(
        *LKEY, "l_quantity", "l_tax", F.when(F.col("l_linestatus") == "O", "test").otherwise("train").alias("split")
    )
    s = C.scale_on_train(s, ["l_quantity", "l_tax"])
    return s.select(*LKEY, "split", rnd("l_quantity", 7).alias("l_quantity"), rnd("l_tax", 7).alias("l_tax"))


@query(
    "sca_12_label_encode",
    "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders",
)
def _(spark, sf):
    return C.label_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


@query(
    "sca_13_first_appearance",
    """WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type)
       SELECT event_id, event_type, code FROM events JOIN f USING (event_type)""",
)
def _(spark, sf):
    return C.first_appearance_codes(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", "code")


@query(
    "sca_14_transform_target",
    f"""SELECT o_orderkey, {R('ln(o_totalprice)', 7)} AS y_log, {R('sqrt(o_totalprice)', 6)} AS y_sqrt,
        {R('o_totalprice / 1000 * (o_totalprice / 1000)', 4)} AS y_square, {R('1000 / o_totalprice', 8)} AS y_inverse FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    y = F.col("o_totalprice")
    for m in ("log", "sqrt", "inverse"):
        C.check_domain(o, "o_totalprice", m)
    return o.select(
        "o_orderkey", rnd(C.transform_target(y, "log"), 7).alias("y_log"), rnd(C.transform_target(y, "sqrt"), 6).alias("y_sqrt"),
        rnd(C.transform_target(y / 1000, "square"), 4).alias("y_square"),
        rnd(C.transform_target(y / 1000, "inverse"), 8).alias("y_inverse"),
    )


@query(
    "sca_15_power_fixed",
    f"""SELECT o_orderkey, {R('(pow(o_totalprice, 0.5) - 1) / 0.5', 5)} AS bc_half, {R('ln(o_totalprice)', 7)} AS bc_zero,
        {R("CASE WHEN z >= 0 THEN (pow(z + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - z, 1.5) - 1) / 1.5 END", 7)} AS yj_half
        FROM (SELECT *, o_totalprice / 100000 - 2 AS z FROM orders)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    y = F.col("o_totalprice")
    return o.select(
        "o_orderkey", rnd(C.boxcox(y, 0.5), 5).alias("bc_half"), rnd(C.boxcox(y, 0.0), 7).alias("bc_zero"),
        rnd(C.yeojohnson(y / 100000 - 2, 0.5), 7).alias("yj_half"),
    )


def _grid_sql():
    """The same five-round grid search, written out as likelihoods per lambda."""
    rounds = []
    for k in range(5):
        if k == 0:
            rounds.append("g0 AS (SELECT -5.0::DOUBLE + i * 0.5::DOUBLE AS lam FROM range(21) t(i))")
        else:
            step = 0.5 / 10**k
            rounds.append(f"g{k} AS (SELECT lam - {step * 10!r}::DOUBLE + i * {step!r}::DOUBLE AS lam FROM b{k - 1}, range(21) t(i))")
        rounds.append(
            f"""b{k} AS (SELECT lam FROM (SELECT lam, -0.5 * count(*) * ln(var_pop(CASE WHEN abs(lam) < 1e-12 THEN ly ELSE (pow(y, lam) - 1) / lam END))
                + (lam - 1) * sum(ly) AS ll FROM g{k}, (SELECT c_acctbal + 1000 AS y, ln(c_acctbal + 1000) AS ly FROM customer) GROUP BY lam)
                ORDER BY ll DESC LIMIT 1)"""
        )
    return f"WITH {', '.join(rounds)} SELECT 'boxcox' AS method, {R('lam', 4)} AS lambda FROM b4"


@query("sca_15_power_lambda", _grid_sql())
def _(spark, sf):
    df = table(spark, sf, "customer").select((F.col("c_acctbal") + 1000).alias("y"))
    lam = C.power_lambda(df, "y", "boxcox")
    return spark.createDataFrame([("boxcox", round(lam, 4) + 0.0)], "method string, lambda double")
