"""Readers, sinks, search and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions.columns import rnd
from assaylake.operators import pca as PC
from assaylake.operators import reports as RP
from assaylake.operators import scoring as SC
from assaylake.operators import search as SE
from assaylake.operators import split as P
from assaylake.operators.regress import linear_formula
from assaylake.plans.registry import query, sql_round as R
from assaylake.plans.reports import report_files
from assaylake.plans.statistics import EMB, embedding_columns
from assaylake.session import new_path
from assaylake.sources import readers as RD
from assaylake.sources import sinks as SK
from assaylake.sources.tables import table
from assaylake.streaming.score import parquet_stream, score_available

CUSTOMER = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
CSV_SQL = """SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"""


def customer_with_tokens(spark, sf):
    """Balances as text with NA marks, as a file would hold them."""
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(b < 0, "NaN").otherwise(b.cast("string")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )


@query("src_01_csv", CSV_SQL)
def _(spark, sf):
    path = new_path(spark, "csv")
    SK.write_csv(customer_with_tokens(spark, sf), path)
    return RD.read_csv(spark, path, CUSTOMER)


@query("src_01_csv_inferred", "SELECT o_orderkey::INT AS o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    path = new_path(spark, "csv")
    SK.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return RD.read_csv(spark, path)


@query("src_02_tsv", CSV_SQL)
def _(spark, sf):
    path = new_path(spark, "tsv")
    SK.write_csv(customer_with_tokens(spark, sf), path, sep="\t")
    return RD.read_tsv(spark, path, CUSTOMER)


NESTED = "SELECT n_nationkey AS id, n_name AS \"place.name\", r_name AS \"place.region.name\", n_regionkey AS \"place.region.key\" FROM nation JOIN region ON r_regionkey = n_regionkey"


def _nested(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    region = F.struct(F.col("r_name").alias("name"), F.col("n_regionkey").alias("key"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name"), region.alias("region")).alias("place"))


@query("src_03_json", NESTED)
def _(spark, sf):
    path, df = new_path(spark, "json"), _nested(spark, sf)
    df.write.json(path)
    return RD.read_json(spark, path, df.schema)


@query("src_03_json_array", 'SELECT doc_id AS id, source AS "from.source", n_chars AS "from.size", text AS "body.text" FROM documents')
def _(spark, sf):
    """Whole texts in files that each hold one array of objects, with and without line breaks between them."""
    path = new_path(spark, "arrays")
    docs = table(spark, sf, "documents")
    row = F.to_json(F.struct(F.col("doc_id").alias("id"), F.struct("source", F.col("n_chars").alias("size")).alias("from"), F.struct("text").alias("body")))
    lists = docs.groupBy(F.floor(F.col("doc_id") / 500).alias("file")).agg(F.collect_list(row).alias("rows"))
    inside = F.when(F.col("file") % 2 == 0, F.array_join("rows", ",")).otherwise(F.array_join("rows", ",\n  "))
    array = F.concat(F.lit("["), inside, F.lit("]")).alias("value")
    lists.select(array).write.option("maxRecordsPerFile", 1).text(path)
    return RD.read_json(spark, path, "id long, from struct<source: string, size: long>, body struct<text: string>", lines=False)


@query("src_04_flatten", NESTED)
def _(spark, sf):
    return RD.flatten(_nested(spark, sf))


@query("src_01_csv_quoted", "SELECT doc_id, 'x,\"' || text || '\"' AS text FROM documents")
def _(spark, sf):
    """Whole texts with line breaks, commas and doubled quotes, through a file and back."""
    path = new_path(spark, "csv")
    SK.write_csv(table(spark, sf, "documents").select("doc_id", F.concat(F.lit('x,"'), "text", F.lit('"')).alias("text")), path)
    return RD.read_csv(spark, path, "doc_id long, text string")


@query("src_05_encoding_fallback", "SELECT doc_id, source, regexp_replace(text, '[^\\x0A\\x20-\\x7E\\x{A0}-\\x{FF}]', '', 'g') AS text FROM documents")
def _(spark, sf):
    """Whole texts of all languages in Latin-1; most lines are plain ASCII."""
    path = new_path(spark, "latin1")
    text = F.regexp_replace("text", "[^\\x0A\\x20-\\x7E\\xA0-\\xFF]", "").alias("text")
    SK.write_csv(table(spark, sf, "documents").select("doc_id", "source", text), path, encoding="ISO-8859-1")
    return RD.read_csv_probed(spark, path, "doc_id long, source string, text string")


@query("src_06_separator_fallback", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf):
    path = new_path(spark, "tabbed")
    SK.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, sep="\t")
    return RD.read_csv_probed(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query(
    "src_08_report_files",
    """SELECT program, CASE WHEN program = 'KOWWIN' THEN n + extra ELSE n END::BIGINT AS n, CASE WHEN program = 'KOWWIN' THEN n + extra ELSE n END::BIGINT AS n_with_weight
       FROM (SELECT count(*) AS n, sum((p_partkey % 5 = 0)::INT) AS extra FROM part), (VALUES ('KOWWIN'), ('BIOWIN'), ('BCFBAF'), ('KOCWIN')) t(program)""",
)
def _(spark, sf):
    """All reports written to compressed text files, and the sections of all four programs read back range by range."""
    path, out = new_path(spark, "reports"), None
    report_files(spark, sf).select("content").write.option("maxRecordsPerFile", 500).option("compression", "gzip").text(path)
    ranges = RP.section_ranges(spark, path)
    for program in RP.PROGRAMS:
        parsed = RP.PARSERS[program](RP.read_sections(spark, path, program, ranges))
        n = parsed.agg(F.lit(program).alias("program"), F.count(F.lit(1)).alias("n"), F.count("mol_weight").alias("n_with_weight"))
        out = n if out is None else out.unionByName(n)
    return out


@query("src_10_csv_sink", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    path = new_path(spark, "sink")
    SK.write_csv(table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("p_brand string, n long").option("header", True).csv(path)


@query("src_11_stages", "SELECT 'original' AS stage, count(*) AS n FROM events UNION ALL SELECT 'clean', count(*) FROM events WHERE value <= 50")
def _(spark, sf):
    ev = table(spark, sf, "events")
    out = None
    for stage, df in (("original", ev), ("clean", ev.where("value <= 50"))):
        n = spark.read.parquet(SK.write_stage(df, stage)).agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "src_12_split_export",
    "SELECT CASE WHEN row_number() OVER (ORDER BY md5('42|' || c_custkey)) <= ceil(count(*) OVER () * 0.3 - 1e-9) THEN 'Test' ELSE 'Train' END AS \"Set\", c_custkey, c_acctbal FROM customer",
)
def _(spark, sf):
    return SK.split_export(P.random_split(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"], 0.3))


# ------------------------------------------------------------------ candidate subsets


def _candidate_data(spark, sf):
    """A target made of four vector elements, with noise from another."""
    e = embedding_columns(spark, sf)
    y = 3 * F.col("e01") - 2 * F.col("e07") + F.col("e12") + 0.5 * F.col("e33") + 0.1 * F.col("e50")
    s = P.random_split(e.withColumn("y", y), ["vec_id"], 0.2)
    return P.kfold(s, ["vec_id"], 5)


PAIRS = [("e01", "e07"), ("e01", "e12"), ("e07", "e12"), ("e01", "e33"), ("e12", "e50")]
PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, embedding[{int(a[1:]) + 1}]::DOUBLE AS u, embedding[{int(b[1:]) + 1}]::DOUBLE AS v, y, test FROM d" for a, b in PAIRS
)


@query(
    "reg_12_candidate_report",
    f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || vec_id)) AS rn, count(*) OVER () AS n FROM embeddings),
        d AS (SELECT embedding, rn <= ceil(n * 0.2 - 1e-9) AS test, 3 * embedding[2]::DOUBLE - 2 * embedding[8]::DOUBLE + embedding[13]::DOUBLE + 0.5 * embedding[34]::DOUBLE + 0.1 * embedding[51]::DOUBLE AS y FROM e),
        p AS ({PAIR_SQL}),
        m AS (SELECT f1, f2, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM p WHERE NOT test GROUP BY 1, 2),
        b AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS bu, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS bv FROM m),
        r AS (SELECT p.f1, p.f2, test, y - (my + bu * (u - mu) + bv * (v - mv)) AS res, y - my AS dev FROM p JOIN b ON p.f1 = b.f1 AND p.f2 = b.f2)
        SELECT f1, f2, {R('1 - sum(res * res) FILTER (NOT test) / sum(dev * dev) FILTER (NOT test)', 6)} AS r2, {R('1 - sum(res * res) FILTER (test) / sum(dev * dev) FILTER (test)', 6)} AS q2 FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    """Split R2 and external Q2 of given two-feature models."""
    options = SE.ReportOptions(best=None, min_r2=-1.0, min_q2=-1.0)
    given = spark.createDataFrame([([a, b],) for a, b in PAIRS], "features array<string>")
    report = SE.candidate_report(_candidate_data(spark, sf), "y", EMB, given, options=options)
    return report.select(F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), rnd("r2", 6).alias("r2"), rnd("q2", 6).alias("q2"))


@query(
    "srt_05_ranked_cut",
    f"SELECT l_suppkey, {R('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 10",
)
def _(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("t"))
    return t.orderBy(F.desc("t"), "l_suppkey").limit(10).select("l_suppkey", rnd("t", 2).alias("total"))


# ------------------------------------------------------------------ streams and user functions


@query(
    "stream_linear_scores",
    f"""SELECT event_id, {R('1.5 + 0.25 * value', 7)} AS score, CASE WHEN value >= 80 THEN 'Low toxicity - cells largely viable' WHEN value >= 50 THEN 'Moderate toxicity - significant cell death'
        WHEN value >= 20 THEN 'High toxicity - majority of cells affected' ELSE 'Severe toxicity - extensive cell death' END AS band FROM events""",
)
def _(spark, sf):
    stream = parquet_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    return score_available(stream, lambda df: df.select(
        "event_id", rnd(linear_formula({"value": 0.25}, 1.5), 7).alias("score"), SC.viability_band(F.col("value")).alias("band")))


@query(
    "stream_pca_scores",
    f"""WITH m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, stddev_pop(p_size) AS sa, stddev_pop(p_retailprice) AS sb FROM part)
        SELECT p_partkey, {R('abs((p_size - a) / sa + (p_retailprice - b) / sb) / sqrt(2)', 6)} AS sum_axis FROM part, m""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    model = PC.fit_pca(part, ["p_size", "p_retailprice"])
    name = "PC1" if model.weights[0, 0] * model.weights[1, 0] > 0 else "PC2"
    stream = parquet_stream(spark, sf, part.schema, "part.parquet")
    return score_available(stream, lambda df: PC.project(df, model, ["p_partkey"]).select("p_partkey", rnd(F.abs(name), 6).alias("sum_axis")))


@query("udf_03_group_aggregate", f"SELECT p_brand, {R('max(p_retailprice) - min(p_retailprice)', 6)} AS spread FROM part GROUP BY 1")
def _(spark, sf):
    """A user aggregate; the built-in form needs no Python and keeps partial aggregation."""
    from assaylake.functions.user import aggregate_by

    return aggregate_by(table(spark, sf, "part"), "p_brand", {"spread": F.max("p_retailprice") - F.min("p_retailprice")}).withColumn("spread", rnd("spread"))


@query(
    "udf_03_merged_aggregate",
    f"SELECT p_brand, count(*) AS n, {R('sum(p_size * p_retailprice) / sum(p_size)', 6)} AS weighted FROM part GROUP BY 1",
)
def _(spark, sf):
    """A Python aggregate in two steps: rows to one partial per batch, partials to the result."""
    from assaylake.functions.user import merge_by

    part = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("w"), "p_retailprice")
    g = merge_by(
        part, "p_brand",
        lambda x: {"n": len(x), "sw": x["w"].sum(), "swx": (x["w"] * x["p_retailprice"]).sum()},
        lambda x: {"n": int(x["n"].sum()), "sw": x["sw"].sum(), "swx": x["swx"].sum()},
        "n long, sw double, swx double",
    )
    return g.select("p_brand", "n", rnd(F.col("swx") / F.col("sw"), 6).alias("weighted"))


@query("udf_01_map_values", f"SELECT event_id, {R('sqrt(value + 1)', 8)} AS mapped FROM events")
def _(spark, sf):
    import numpy as np

    from assaylake.functions.user import map_values

    ev = map_values(table(spark, sf, "events").select("event_id", "value"), "value", lambda x: np.sqrt(x + 1), out="mapped")
    return ev.select("event_id", rnd("mapped", 8).alias("mapped"))


@query(
    "udf_04_linear_formula",
    f"SELECT o_orderkey, {R('-3.5 + 0.002 * o_totalprice + 0.01 * o_custkey', 6)} AS predicted FROM orders",
)
def _(spark, sf):
    from assaylake.operators.regress import apply_formula

    return apply_formula(table(spark, sf, "orders"), {"o_totalprice": 0.002, "o_custkey": 0.01}, -3.5, "predicted").select("o_orderkey", rnd("predicted").alias("predicted"))


@query(
    "udf_05_file_records",
    "SELECT 'part-' || p_partkey || '.txt' AS file, CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 4 END::BIGINT AS n_records FROM part",
)
def _(spark, sf):
    files, out = report_files(spark, sf), None
    for program in RP.PROGRAMS:
        s = RP.sections(files, program).select("file")
        out = s if out is None else out.unionByName(s)
    return out.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"))


@query(
    "jon_12_row_by_grid",
    f"SELECT s_suppkey, {R('10 ** (-1 + i * (3.0::DOUBLE / 19))', 6)} AS conc FROM supplier, range(20) t(i)",
)
def _(spark, sf):
    g = SC.concentration_grid(table(spark, sf, "supplier").select("s_suppkey"), 0.1, 100.0, 20, "conc")
    return g.select("s_suppkey", rnd("conc", 6).alias("conc"))
