"""Train/test splits, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import split as P
from assaylake.plans.registry import query
from assaylake.sources.tables import table

OKEY = ["o_orderkey"]


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")


HASHED = "h AS (SELECT o_orderkey, o_totalprice, o_orderdate, md5('42|' || o_orderkey) AS h, count(*) OVER () AS n FROM orders)"


@query(
    "spl_01_random",
    f"""WITH {HASHED} SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY h) <= ceil(n * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM h""",
)
def _(spark, sf):
    return P.random_split(orders(spark, sf), OKEY, 0.2).select("o_orderkey", "split")


@query(
    "spl_02_stratified",
    f"""WITH {HASHED}, q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders),
        b AS (SELECT o_orderkey, h, (o_totalprice > e[1])::INT + (o_totalprice > e[2])::INT + (o_totalprice > e[3])::INT + (o_totalprice > e[4])::INT AS bin FROM h, q)
        SELECT o_orderkey, bin, CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY h) <= ceil(count(*) OVER (PARTITION BY bin) * 0.25 - 1e-9)
        THEN 'test' ELSE 'train' END AS split FROM b""",
)
def _(spark, sf):
    return P.stratified_split(orders(spark, sf), OKEY, "o_totalprice", 0.25, 5).select("o_orderkey", "bin", "split")


@query(
    "spl_03_time",
    f"""WITH {HASHED} SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM h""",
)
def _(spark, sf):
    return P.time_split(orders(spark, sf), "o_orderdate", OKEY, 0.2).select("o_orderkey", "split")


RANKED = "r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


@query(
    "spl_04_endpoints",
    f"""WITH {RANKED}, mp AS (SELECT min(pos) AS p FROM r WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)),
        i AS (SELECT o_orderkey, pos, p, pos - 1 - (pos > p)::INT AS i FROM r, mp)
        SELECT o_orderkey, CASE WHEN pos = 0 OR pos = p OR i % 3 = 2 THEN 'test' ELSE 'train' END AS split FROM i""",
)
def _(spark, sf):
    return P.endpoints_split(orders(spark, sf), "o_totalprice", OKEY, 3).select("o_orderkey", "split")


@query(
    "spl_05_systematic",
    f"WITH {RANKED} SELECT o_orderkey, CASE WHEN (pos >= 2 AND pos < n - 1 AND (pos - 2) % 3 = 0) OR pos = n - 1 THEN 'test' ELSE 'train' END AS split FROM r",
)
def _(spark, sf):
    return P.systematic_split(orders(spark, sf), "o_totalprice", OKEY, 3).select("o_orderkey", "split")


@query(
    "spl_06_systematic_from_zero",
    f"WITH {RANKED} SELECT o_orderkey, CASE WHEN pos % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM r",
)
def _(spark, sf):
    return P.systematic_split(orders(spark, sf), "o_totalprice", OKEY, 4, start=0, stop_before_last=False, include_last=False).select(
        "o_orderkey", "split"
    )


@query(
    "spl_07_predefined",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'train' ELSE 'test' END AS split FROM documents",
)
def _(spark, sf):
    return P.predefined_split(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


FOLD = "CAST(CASE WHEN rn < (n // 5 + 1) * (n % 5) THEN rn // (n // 5 + 1) ELSE n % 5 + (rn - (n // 5 + 1) * (n % 5)) // (n // 5) END AS INTEGER)"


@query(
    "spl_08_kfold",
    f"WITH {HASHED}, k AS (SELECT o_orderkey, n, row_number() OVER (ORDER BY h) - 1 AS rn FROM h) SELECT o_orderkey, {FOLD} AS fold FROM k",
)
def _(spark, sf):
    return P.kfold(orders(spark, sf), OKEY, 5).select("o_orderkey", "fold")


@query(
    "spl_08_kfold_ordered",
    f"WITH k AS (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM orders) SELECT o_orderkey, {FOLD} AS fold FROM k",
)
def _(spark, sf):
    return P.ordered_kfold(orders(spark, sf), ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "fold")


@query("spl_09_sorted_folds", f"WITH {RANKED} SELECT o_orderkey, CAST(pos % 5 AS INTEGER) AS fold FROM r")
def _(spark, sf):
    return P.sorted_folds(orders(spark, sf), "o_totalprice", OKEY, 5).select("o_orderkey", "fold")


# ------------------------------------------------------------------ set operations


@query(
    "set_01_union_blocks",
    "SELECT o_orderkey, 'test' AS split FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'train' FROM orders WHERE o_orderstatus <> 'P'",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    test = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("test").alias("split"))
    train = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("train").alias("split"))
    return train.unionByName(test)


@query("set_02_all_minus_test", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_03_shared_keys", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def _(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return left.intersect(table(spark, sf, "customer").select("c_custkey"))


@query("set_04_distinct_union", "SELECT p_brand AS item FROM part UNION SELECT p_type FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("item")).union(p.select("p_type")).distinct()


@query(
    "set_05_append_rows",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return c.unionByName(s, allowMissingColumns=True)
