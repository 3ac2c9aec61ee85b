"""Numeric text, key discovery, joins and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import text as X
from assaylake.functions.columns import rnd
from assaylake.operators import keyjoin as K
from assaylake.operators import rules as RU
from assaylake.plans.registry import query, sql_round as R
from assaylake.sources.tables import table

# Every balance has a text form by customer: decimal comma, plain, parentheses, %, thousands marks, junk.
PARSED = """CASE c_custkey % 8 WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal WHEN 2 THEN -abs(c_acctbal) WHEN 3 THEN c_acctbal / 100
  WHEN 4 THEN CASE WHEN c_acctbal <= -1000 THEN NULL ELSE (CAST(trunc(c_acctbal) AS BIGINT) // 1000) * 1000 + abs(CAST(trunc(c_acctbal) AS BIGINT) % 1000) END
  WHEN 5 THEN (1 + abs(CAST(trunc(c_acctbal) AS BIGINT) // 1000)) * 1000 + abs(CAST(trunc(c_acctbal) AS BIGINT) % 1000) + 0.5 END"""


def text_balances(spark, sf):
    b = F.col("c_acctbal")
    two = F.format_string("%.2f", b)
    whole = b.cast("long")  # truncates like the oracle
    tail = F.lpad(F.abs(whole % 1000).cast("string"), 3, "0")
    kind = F.col("c_custkey") % 8
    t = (
        F.when(kind == 0, F.translate(two, ".", ","))
        .when(kind == 1, two)
        .when(kind == 2, F.concat(F.lit("("), F.format_string("%.2f", F.abs(b)), F.lit(")")))
        .when(kind == 3, F.concat(two, F.lit("%")))
        .when(kind == 4, F.concat(F.lit("\u00a0"), F.expr("cast(c_acctbal as bigint) div 1000").cast("string"), F.lit(" "), tail, F.lit("\u202f")))
        .when(kind == 5, F.concat((1 + F.abs(F.expr("cast(c_acctbal as bigint) div 1000"))).cast("string"), F.lit("."), tail, F.lit(",50")))
        .when(kind == 6, "n/a")
    )
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", t.alias("t"))


@query(
    "sca_01_numeric_text",
    f"""SELECT c_custkey, {R(PARSED)} AS t FROM customer""",
)
def _(spark, sf):
    df = X.coerce_numeric_text(text_balances(spark, sf).select("c_custkey", "t"))
    return df.select("c_custkey", rnd("t").alias("t"))


@query(
    "src_07_side_table",
    f"""SELECT c_custkey AS "the key", {R(PARSED)} AS "end point", c_mktsegment AS segment FROM customer""",
)
def _(spark, sf):
    from assaylake.sources.readers import side_table

    df = text_balances(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    df = df.select(F.col("c_custkey").alias("the\tkey"), F.col("t").alias(" end\r\npoint"), F.col("c_mktsegment").alias("segment "))
    return side_table(df).withColumn("end point", rnd("end point"))


def messy_key(c, alt):
    """The same key as '1', '1.0', ' 1 ', '1,0' or with no-break spaces, by ``alt``."""
    s = c.cast("string")
    k = alt % 6
    return (
        F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(".0"))).when(k == 2, F.concat(F.lit(" "), s, F.lit(" ")))
        .when(k == 3, F.concat(s, F.lit(",0"))).when(k == 4, F.concat(F.lit("\u00a0"), s)).otherwise(F.lit("N/A"))
    )


@query(
    "sca_02_normalise_key",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS key,
       CASE WHEN o_orderkey % 3 = 0 THEN '00' || o_custkey WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 97 AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END
       ELSE 'ID-' || o_custkey END AS other FROM orders""",
)
def _(spark, sf):
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    frac = F.format_string("%.3f", (ok % 97) + (ok % 4) / 4.0)
    other = F.when(ok % 3 == 0, F.concat(F.lit("00"), ck.cast("string"))).when(ok % 3 == 1, F.translate(frac, ".", ",")).otherwise(F.concat(F.lit("ID-"), ck.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", X.normalise_key(messy_key(ck, ok)).alias("key"), X.normalise_key(other).alias("other"))


def messy_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", messy_key(F.col("o_custkey"), F.col("o_orderkey")).alias("cust"))


MATCH = """s AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 6 <> 5 GROUP BY 1)"""


@query("jon_01_attach_numeric", f"WITH {MATCH} SELECT c_custkey, c_name, {R('v', 7)} AS price FROM customer LEFT JOIN s ON k = c_custkey")
def _(spark, sf):
    j = K.attach_by_key(table(spark, sf, "customer").select("c_custkey", "c_name"), messy_orders(spark, sf), "c_custkey", "o_totalprice", "cust", "price")
    return j.withColumn("price", rnd("price", 7))


@query(
    "jon_01_attach_category",
    """WITH s AS (SELECT k, p FROM (SELECT o_custkey AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
       FROM orders WHERE o_orderkey % 6 <> 5 GROUP BY 1, 2) WHERE rn = 1) SELECT c_custkey, p AS priority FROM customer LEFT JOIN s ON k = c_custkey""",
)
def _(spark, sf):
    return K.attach_by_key(table(spark, sf, "customer").select("c_custkey"), messy_orders(spark, sf), "c_custkey", "o_orderpriority", "cust", "priority")


@query(
    "jon_01_match_summary",
    f"WITH {MATCH} SELECT count(v) AS matched, count(*) AS total, {R('count(v) / count(*)')} AS match_ratio FROM customer LEFT JOIN s ON k = c_custkey",
)
def _(spark, sf):
    j = K.attach_by_key(table(spark, sf, "customer").select("c_custkey"), messy_orders(spark, sf), "c_custkey", "o_totalprice", "cust", "price")
    return K.match_summary(j, "price").withColumn("match_ratio", rnd("match_ratio"))


@query(
    "jon_02_inner_join",
    "SELECT c.c_custkey AS key, c_nationkey AS nation_pca, s.s_nationkey AS nation_ext, c_acctbal, s_acctbal FROM customer c JOIN supplier s ON s_suppkey = c_custkey",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_nationkey AS nation", "c_acctbal")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_nationkey AS nation", "s_acctbal")
    return K.inner_join(c, s, "key")


@query(
    "jon_03_key_overlap",
    f"""WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 6 <> 5)
        SELECT 'cust' AS "column", {R('(SELECT count(*) FROM l WHERE k IN (SELECT k FROM r)) / (SELECT count(*) FROM l)')} AS overlap""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"))
    return K.key_overlap(c, messy_orders(spark, sf), "cust").withColumn("overlap", rnd("overlap"))


def _sides(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_name AS label", "c_acctbal")
    s = table(spark, sf, "supplier").selectExpr("concat(s_suppkey, '.0') AS id", "s_nationkey AS nation", "s_name AS label", "s_acctbal")
    return c, s


def _candidates_sql():
    parts = []
    for name, l, r in (("id", "c_custkey", "s_suppkey"), ("nation", "c_nationkey", "s_nationkey"), ("label", "c_name", "s_name")):
        parts.append(
            f"SELECT '{name}' AS c, (SELECT count(DISTINCT {l}) FROM customer WHERE {l} IN (SELECT {r} FROM supplier)) / (SELECT count(DISTINCT {l}) FROM customer) AS o, "
            f"least((SELECT count(DISTINCT {l}) / count({l}) FROM customer), (SELECT count(DISTINCT {r}) / count({r}) FROM supplier)) AS u"
        )
    return f"""WITH k AS ({' UNION ALL '.join(parts)}) SELECT c AS "column", {R('o')} AS overlap, {R('u')} AS uniqueness, {R('0.75 * o + 0.25 * u')} AS score,
      o >= 0.6 OR (o >= 0.4 AND u >= 0.8) AS accepted, CASE WHEN o >= 0.75 THEN 'high' WHEN o >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM k"""


@query("jon_04_key_candidates", _candidates_sql())
def _(spark, sf):
    t = K.key_candidates(*_sides(spark, sf))
    return t.withColumns({c: rnd(c) for c in ("overlap", "uniqueness", "score")})


@query(
    "jon_05_join_readiness",
    """WITH o AS (SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)) / (SELECT count(*) FROM customer) AS o),
       d AS (SELECT count(DISTINCT s_name) AS n FROM supplier)
       SELECT 'id' AS "column", 'key' AS kind, CASE WHEN o < 0.3 THEN 'low overlap' WHEN o < 0.6 THEN 'medium overlap' ELSE 'good overlap' END AS note FROM o
       UNION ALL SELECT 'nation', 'numeric', '' UNION ALL SELECT 's_acctbal', 'numeric', ''
       UNION ALL SELECT 'label', 'categorical', CASE WHEN n > 150 THEN 'many categories' WHEN n = 1 THEN 'single value' ELSE '' END FROM d""",
)
def _(spark, sf):
    return K.join_readiness(*_sides(spark, sf), "id")


# ------------------------------------------------------------------ rules

SEGMENTS = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]


@query(
    "flt_06_validate",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS seg,
         CASE WHEN c_custkey % 13 = 0 THEN 'abc' WHEN c_custkey % 17 = 0 THEN NULL ELSE printf('%.2f', c_acctbal) END AS bal FROM customer),
       e AS (SELECT *, seg = '' AS m1, bal IS NULL AS m2, seg NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') AS bad, TRY_CAST(bal AS DOUBLE) AS v FROM c)
       SELECT c_custkey, CASE WHEN m1 OR m2 THEN concat_ws('; ', CASE WHEN m1 THEN 'Missing required field: seg' END, CASE WHEN m2 THEN 'Missing required field: bal' END)
         ELSE concat_ws('; ', CASE WHEN bad THEN 'Invalid seg value: ' || seg END, CASE WHEN v IS NULL THEN 'bal must be a valid number' END,
         CASE WHEN v < 0 OR v > 5000 THEN 'bal must be between 0 and 5000' END) END AS errors,
         NOT (m1 OR m2) AND NOT bad AND coalesce(v BETWEEN 0 AND 5000, false) AS is_valid FROM e""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(
        k, F.when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when(k % 13 == 0, "abc").when(k % 17 == 0, None).otherwise(F.format_string("%.2f", "c_acctbal")).alias("bal"),
    )
    v = RU.validate(df, ["seg", "bal"], {"seg": SEGMENTS}, {"bal": (0, 5000)})
    return v.select("c_custkey", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(
    "flt_07_range_reason",
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'below' WHEN p_size > 40 THEN 'above' ELSE 'within' END AS reason FROM part",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", RU.range_reason("p_size", 10, 40).alias("reason"))


def _order_items(spark, sf):
    """Per order: its return flags as (item, count), plus part brands seen."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).cast("int").alias("count"))
    item = F.concat(F.lit("flag "), F.col("l_returnflag"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(item.alias("item"), "count"))).alias("items"))


STATUS_SQL = """SELECT l_orderkey, 'flag ' || l_returnflag AS item, count(*)::INT AS count, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS max_count,
  CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN count(*) > CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END THEN 'exceeded' ELSE 'ok' END AS status
  FROM lineitem GROUP BY l_orderkey, l_returnflag"""


@query("jon_08_count_limits", STATUS_SQL)
def _(spark, sf):
    s = _order_items(spark, sf).select("l_orderkey", F.explode(RU.count_status(F.col("items"), {"flag A": 1, "flag N": 2})).alias("s"))
    return s.select("l_orderkey", "s.item", "s.count", "s.max_count", "s.status")


@query("jon_08_count_limits_join", STATUS_SQL)
def _(spark, sf):
    limits = table(spark, sf, "lineitem").where("l_returnflag <> 'R'").select(
        F.concat(F.lit("flag "), F.col("l_returnflag")).alias("item"), F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("max_count")
    ).distinct()
    return RU.count_status_join(_order_items(spark, sf), "items", limits, ["l_orderkey"]).drop("item_no")


@query(
    "win_08_first_per_item",
    """WITH w AS (SELECT doc_id, unnest(string_split(lang || ' ' || source || ' ' || lang || ' x', ' ')) AS item, unnest(range(10)) AS pos FROM documents)
       SELECT doc_id, item, min(pos)::INT AS count FROM w WHERE item IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    words = F.split(F.concat_ws(" ", "lang", "source", "lang", F.lit("x")), " ")
    items = F.transform(words, lambda w, i: F.struct(w.alias("item"), i.alias("count")))
    return d.select("doc_id", F.explode(RU.first_per_item(items)).alias("s")).select("doc_id", "s.item", "s.count")


# ------------------------------------------------------------------ row-wise scalar functions


@query(
    "sca_16_log_concentration",
    f"SELECT s_suppkey, {R('CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) ELSE 0 END', 8)} AS log_conc FROM supplier",
)
def _(spark, sf):
    from assaylake.operators.scoring import log_concentration

    return table(spark, sf, "supplier").select("s_suppkey", rnd(log_concentration(F.col("s_acctbal")), 8).alias("log_conc"))


@query(
    "src_14_safe_output",
    """SELECT doc_id, CASE WHEN length(t) > 200 THEN substring(t, 1, 199) || '…' ELSE t END AS text, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars::DOUBLE END AS n
       FROM (SELECT doc_id, n_chars, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g') AS t FROM documents)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("n_chars").cast("double")
    noisy = F.when(F.col("n_chars") % 3 == 0, F.when(F.col("n_chars") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(n)
    return d.select("doc_id", X.safe_text(F.col("text")).alias("text"), X.finite(noisy).alias("n"))


@query("sca_20_collapse_spaces", r"SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.collapse_spaces(F.col("text")).alias("text"))


# Formulas made from all letters of every text.
FORM_SQL = """f AS (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w, lang, source,
  CASE doc_id % 4 WHEN 0 THEN '<think>why ' || chr(10) || lang || '</think> "' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || '"[tiab] OR (' || lang || '[MeSH Terms])'
  WHEN 1 THEN '(' || source || '[tw] OR ' || lang || '[ti]) AND x' WHEN 2 THEN repeat('"' || lang || '" OR ', 60) || lang ELSE '[THINKING]a[/thinking]' || lang END AS q FROM documents)"""


def formulas(spark, sf):
    d = table(spark, sf, "documents")
    w = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    k = F.col("doc_id") % 4
    q = (
        F.when(k == 0, F.concat(F.lit("<think>why \n"), F.col("lang"), F.lit('</think> "'), w, F.lit('"[tiab] OR ('), F.col("lang"), F.lit("[MeSH Terms])")))
        .when(k == 1, F.concat(F.lit("("), F.col("source"), F.lit("[tw] OR "), F.col("lang"), F.lit("[ti]) AND x")))
        .when(k == 2, F.concat(F.repeat(F.concat(F.lit('"'), F.col("lang"), F.lit('" OR ')), F.lit(60)), F.col("lang")))
        .otherwise(F.concat(F.lit("[THINKING]a[/thinking]"), F.col("lang")))
    )
    return d.select("doc_id", "lang", "source", w.alias("w"), q.alias("q"))


@query(
    "sca_22_strip_reasoning",
    f"WITH {FORM_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\"' || w || '\"[tiab] OR (' || lang || '[MeSH Terms])' WHEN 3 THEN lang ELSE q END AS q FROM f",
)
def _(spark, sf):
    return formulas(spark, sf).select("doc_id", X.strip_reasoning(F.col("q")).alias("q"))


@query(
    "sca_23_strip_field_tags",
    f"WITH {FORM_SQL} SELECT doc_id, trim(replace(replace(replace(replace(q, '[tiab]', ''), '[MeSH Terms]', ''), '[tw]', ''), '[ti]', '')) AS q FROM f",
)
def _(spark, sf):
    return formulas(spark, sf).select("doc_id", X.strip_field_tags(F.col("q")).alias("q"))


@query("sca_24_is_repetitive", "SELECT doc_id, r AS copy, r = 1 AS repetitive FROM documents, (SELECT 0 AS r UNION ALL SELECT 1)")
def _(spark, sf):
    """Every text with its words numbered, once as it is and once as forty times the same long phrase."""
    d = table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "[ \\n]+"), lambda w, i: F.concat(w, i.cast("string"))), " ").alias("q"))
    phrase = F.concat(F.lit('"a phrase of words" OR '))
    plain = d.select("doc_id", F.lit(0).alias("copy"), X.is_repetitive(F.col("q")).alias("repetitive"))
    return plain.unionByName(d.select("doc_id", F.lit(1).alias("copy"), X.is_repetitive(F.repeat(phrase, F.lit(40))).alias("repetitive")))


@query(
    "sca_25_spelling_fix",
    """WITH p AS (SELECT p_partkey, lower(p_name) AS a, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN replace(p_name, 'e', '') WHEN 2 THEN p_name || ' and more' ELSE left(p_name, 4) END AS b FROM part)
       SELECT p_partkey, a <> lower(b) AND levenshtein(a, lower(b)) <= greatest(3, length(a) // 10) AND length(b) / length(a) > 0.7 AS fix FROM p""",
)
def _(spark, sf):
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    b = F.when(k == 0, F.lower(n)).when(k == 1, F.replace(n, F.lit("e"), F.lit(""))).when(k == 2, F.concat(n, F.lit(" and more"))).otherwise(F.substring(n, 1, 4))
    return table(spark, sf, "part").select("p_partkey", X.is_spelling_fix(n, b).alias("fix"))


@query(
    "sca_26_main_term",
    f"WITH {FORM_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN w WHEN 1 THEN source WHEN 2 THEN lang ELSE '' END AS term FROM f",
)
def _(spark, sf):
    return formulas(spark, sf).select("doc_id", X.main_term(F.col("q")).alias("term"))


@query(
    "sca_27_combine_formulas",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN t WHEN doc_id % 3 = 1 THEN '(' || t || ') AND (' || source || ')' ELSE '(' || source || ')' END AS q FROM (SELECT *, lang || '-' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || '.' AS t FROM documents)",
)
def _(spark, sf):
    k = F.col("doc_id") % 3
    t = F.concat("lang", F.lit("-"), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), F.lit("."))
    arr = F.when(k == 0, F.array(t)).when(k == 1, F.array(t, F.col("source"))).otherwise(F.array(F.lit(" "), F.col("source")))
    return table(spark, sf, "documents").select("doc_id", X.combine_formulas(arr, "AND").alias("q"))
