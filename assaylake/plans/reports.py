"""Report-text, domain-verdict, scoring and search-sheet queries.

The report texts are put together by Spark from ``part`` rows, one text per
part, so their number and the parsing work grow with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.functions import limits as L
from assaylake.functions.columns import rnd
from assaylake.operators import domain as D
from assaylake.operators import reports as RP
from assaylake.operators import scoring as SC
from assaylake.operators import sheets as SH
from assaylake.operators.keyjoin import align_records, first_match_join
from assaylake.plans.registry import query, sql_round as R
from assaylake.session import spread
from assaylake.sources import readers as RD
from assaylake.sources.tables import table

HEAD = """SMILES : C{size}CC
     O{key}
CHEM   : {name}
MOL FOR: C{size} H10
MOL WT : {mw}
"""

KOW_TEXT = """------------------------------ KOWWIN v1.68 estimate --------------------------

KOWWIN Program (v1.68) Results:
===============================

   Log Kow(version 1.68 estimate): {kow}

-------+-----+--------------------------------------------+---------+--------
 TYPE  | NUM |        LOGKOW FRAGMENT DESCRIPTION         |  COEFF  |  VALUE
-------+-----+--------------------------------------------+---------+--------
 Frag  |  {n}  |  -CH3    [aliphatic carbon]                | 0.5473  |  1.0946
 Frag  |  2  |  {brand}  [made up]                        | {coef}  |  0.5000
 Factor|  1  |  Ring reaction                             |-0.1000  | -0.1000
 Const |     |  Equation Constant                         |         |  0.2290
-------+-----+--------------------------------------------+---------+--------
                                                         Log Kow   =   {kow}

"""

BIO_HEAD = "BIOWIN (v4.10) Program Results:\n==============================\n" + HEAD + """{note}--------------------------- BIOWIN v4.10 Results ----------------------------

   Biowin1 (Linear Model Prediction)    :  Biodegrades Fast
   Biowin3 (Ultimate Biodegradation Timeframe):  Weeks-Months
   Biowin5 (MITI Linear Model Prediction)    :  Not printed
"""

BIO_TABLE = """
------+-----+--------------------------------------------+---------+---------
 TYPE | NUM | Biowin%d FRAGMENT DESCRIPTION               |  COEFF  |  VALUE
------+-----+--------------------------------------------+---------+---------
 Frag |  {n}  | Ester   [-C(=O)-O-C]                       |  0.1742 | {v%d}
 Frag |  1  | {brand} [unlisted]                         |  0.0100 |  0.0100
 MolWt|  *  |  Molecular Weight Parameter                |         | -0.0500
 Const|  *  |  Equation Constant                         |         |  %s
============+============================================+=========+=========
   RESULT   |   Biowin%d result                           |         |  {r%d}
============+============================================+=========+=========
"""

BCF_TEXT = "BCFBAF Program (v3.01) Results:\n==============================\n" + HEAD + """--------------------------------- BCFBAF v3.01 --------------------------------
Summary Results:
  Log BCF (regression-based estimate):  {kow}  (BCF = {mw} L/kg wet-wt)
  Biotransformation Half-Life (days) :  {coef}  (normalized to 10 g fish)
  Log BAF (Arnot-Gobas upper trophic):  {kow}  (BAF = {mw} L/kg wet-wt)

Log Kow (experimental):  not available
Log Kow used by BCF estimates:  {kow}

Correction(s):                    Value
   {brand} rule                   -0.150

   Estimated Log BCF =  {kow}

-----+-----+--------------------------------------------+---------+--------
TYPE | NUM | LOG BIOTRANSFORMATION FRAGMENT DESCRIPTION |  COEFF  |  VALUE
-----+-----+--------------------------------------------+---------+--------
Frag |  {n}  |  Aliphatic alcohol [-OH]                   | -0.0616 | -0.0616
L Kow|  *  |  Log Kow =   2.00 (estimate)               |  0.3073 |  {coef}
MolWt|  *  |  Molecular Weight Parameter                |         | -0.2000
Const|  *  |  Equation Constant                         |         | -1.5371
============+============================================+=========+========
RESULT      |        LOG Bio Half-Life (days)            |         | -1.0000
RESULT      |            Bio Half-Life (days)            |         |  {coef}
============+============================================+=========+========
Biotransformation Rate Constant:
 kM (Rate Constant):  1 /day

Arnot-Gobas BCF & BAF Methods (including biotransformation rate estimates):
   Estimated Log BCF (upper trophic) =  {kow} (BCF = {mw} L/kg wet-wt)
   Estimated Log BAF (upper trophic) =  {kow} (BAF = {mw} L/kg wet-wt)
   Estimated Log BCF (mid trophic)   =  {coef} (BCF = 10.5 L/kg wet-wt)

Arnot-Gobas BCF & BAF Methods (assuming a biotransformation rate of zero):
   Estimated Log BCF (upper trophic) =  {coef} (BCF = 12.25 L/kg wet-wt)

"""

KOC_TEXT = HEAD + """
KOCWIN Program (v2.00) Results:
==============================

  Koc Estimate from MCI:
  ---------------------
      First Order Molecular Connectivity Index  ........... : {coef}
      Non-Corrected Log Koc (0.5213 MCI + 0.60) ........... : {kow}
      Fragment Correction(s):
             {n}   Ester  (-C-CO-O-C-) or (HCO-O-C) ........... : -1.2970
             1   {brand}   rule  .............................. : -0.1000
      Corrected Log Koc  .................................. : {kow}

                      Estimated Koc:  {mw}  L/kg   <===========

  Koc Estimate from Log Kow:
  -------------------------
      Log Kow  (Kowwin estimate)  ......................... : {kow}
      Non-Corrected Log Koc (0.55313 logKow + 0.9251) ..... : {coef}
      Fragment Correction(s):  --> No Applicable Correction Factors
      Corrected Log Koc  .................................. : {coef}

                      Estimated Koc:  1,{n}34.5  L/kg   <===========

"""

CONSTANTS = {1: "0.7475", 2: "3.0087", 3: "3.1992", 4: "3.8477", 5: "0.7121", 6: "2.5257"}
BIO_TEXT = BIO_HEAD + "".join(BIO_TABLE % (n, n, CONSTANTS[n], n, n) for n in range(1, 7)) + "\n"
NOTE = "NOTE:  METAL (Na)  HAS BEEN REMOVED to allow estimation\n\n"

# Oracle twins of the inserted values.
V = """v AS (SELECT 'part-' || p_partkey || '.txt' AS file, p_partkey AS key, p_size AS size, p_name AS name, p_brand AS brand, (p_size % 9 + 1)::INT AS n,
  printf('%.2f', floor(p_retailprice) / 2) AS mw, printf('%.2f', (p_size - 20) / 4.0) AS kow, printf('%.4f', p_size / 70.0) AS coef, p_partkey % 7 = 0 AS salt FROM part)"""


def fill(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def report_files(spark, sf):
    """One report per part: all four programs, and a second compound with KOWWIN only in every fifth."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    values = {
        "key": F.col("p_partkey").cast("string"), "size": size.cast("string"), "name": F.col("p_name"), "brand": F.col("p_brand"),
        "n": (size % 9 + 1).cast("string"), "mw": F.format_string("%.2f", F.floor(price) / 2), "kow": F.format_string("%.2f", (size - 20) / 4.0),
        "coef": F.format_string("%.4f", size / 70.0), "note": F.when(F.col("p_partkey") % 7 == 0, NOTE).otherwise(""),
    }
    for n in range(1, 7):
        values[f"v{n}"] = F.format_string("%.4f", (size - 25) / (40.0 + n))
        values[f"r{n}"] = F.format_string("%.4f", (size + n) / 60.0)
    body = fill(HEAD + KOW_TEXT + BIO_TEXT + BCF_TEXT + KOC_TEXT, values)
    extra = F.when(F.col("p_partkey") % 5 == 0, fill(HEAD + KOW_TEXT, values | {"name": F.lit("second compound")})).otherwise("")
    return spread(table(spark, sf, "part"), "p_partkey").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("file"), F.concat(body, extra).alias("content")
    )


def _smiles(size: str, key: str) -> str:
    return f"'C' || {size} || 'CCO' || {key}"


@query(
    "chm_01_sections",
    f"""WITH {V} SELECT file, 'KOWWIN' AS program, 1::INT AS record_index, 'KOWWIN Program (v1.68) Results:' AS header FROM v
        UNION ALL SELECT file, 'KOWWIN', 2, 'KOWWIN Program (v1.68) Results:' FROM v WHERE key % 5 = 0
        UNION ALL SELECT file, 'BIOWIN', 1, 'BIOWIN (v4.10) Program Results:' FROM v UNION ALL SELECT file, 'BCFBAF', 1, 'BCFBAF Program (v3.01) Results:' FROM v
        UNION ALL SELECT file, 'KOCWIN', 1, 'KOCWIN Program (v2.00) Results:' FROM v""",
)
def _(spark, sf):
    files, out = report_files(spark, sf), None
    for p in RP.PROGRAMS:
        s = RP.sections(files, p).select("file", F.lit(p).alias("program"), "record_index", F.split("section", "\n")[0].alias("header"))
        out = s if out is None else out.unionByName(s)
    return out


@query(
    "chm_02_fields",
    f"""WITH {V} SELECT file, 1::INT AS record_index, {_smiles('size', 'key')} AS smiles, 'C' || size || ' H10' AS mol_formula, CAST(mw AS DOUBLE) AS mol_weight, name AS chem_id FROM v""",
)
def _(spark, sf):
    return RP.identity(RP.sections(report_files(spark, sf), "KOCWIN"), context_first=True, weight_commas=True).select("file", "record_index", *RP.LABELS)


@query(
    "chm_03_kowwin",
    f"""WITH {V}, two AS (SELECT *, 1::INT AS record_index FROM v UNION ALL SELECT * REPLACE ('second compound' AS name), 2 FROM v WHERE key % 5 = 0)
        SELECT file, record_index, name AS chem_id, CAST(kow AS DOUBLE) AS log_kow, t.type, CASE t.i WHEN 1 THEN n WHEN 2 THEN 2 ELSE 1 END AS count,
        CASE t.i WHEN 1 THEN '-CH3 [aliphatic carbon]' WHEN 2 THEN brand || ' [made up]' ELSE 'Ring reaction' END AS item,
        CASE t.i WHEN 1 THEN 0.5473::DOUBLE WHEN 2 THEN CAST(coef AS DOUBLE) ELSE -0.1::DOUBLE END AS coefficient
        FROM two, (VALUES (1, 'Frag'), (2, 'Frag'), (3, 'Factor')) t(i, type)""",
)
def _(spark, sf):
    k = RP.parse_kowwin(report_files(spark, sf))
    return k.select("file", "record_index", "chem_id", "log_kow", F.explode("fragments").alias("f")).select(
        "file", "record_index", "chem_id", "log_kow", "f.type", "f.count", "f.item", "f.coefficient"
    )


def _bio_sql():
    parts = []
    for n in range(1, 7):
        lin = f"CAST(printf('%.4f', (size - 25) / {40.0 + n}) AS DOUBLE) + 0.01 - 0.05"
        rep = f"CAST(printf('%.4f', (size + {n}) / 60.0) AS DOUBLE)"
        if n == 2:
            total, prob, rating = f"3.0087 + {lin}", f"1 / (1 + exp(-(3.0087 + {lin})))", "NULL"
        elif n == 6:
            total, prob, rating = f"CASE WHEN {rep} > 0 AND {rep} < 1 THEN ln({rep} / (1 - {rep})) ELSE {lin} END", rep, "NULL"
        elif n in (3, 4):
            total, prob, rating = f"{lin} + {CONSTANTS[n]}", "NULL", f"{lin} + {CONSTANTS[n]}"
        else:
            total, prob, rating = f"{lin} + {CONSTANTS[n]}", rep, "NULL"
        cat = f"CASE WHEN r > 4.75 THEN 'Hours' WHEN r > 4.25 THEN 'Hours to Days' WHEN r > 3.75 THEN 'Days' WHEN r > 3.25 THEN 'Days to Weeks' WHEN r > 2.75 THEN 'Weeks' WHEN r > 2.25 THEN 'Weeks to Months' WHEN r > 1.75 THEN 'Months' WHEN r IS NOT NULL THEN 'Recalcitrant' END"
        printed = {1: "'Biodegrades Fast'", 3: "'Weeks-Months'", 5: "'Not printed'"}.get(n, "NULL")
        parts.append(
            f"SELECT file, {n} AS model, {R('t')} AS total, {R('p')} AS probability, {R('r')} AS rating, {cat} AS time_category, {printed} AS printed, 2::INT AS n_fragments "
            f"FROM (SELECT file, {total} AS t, {prob}::DOUBLE AS p, {rating}::DOUBLE AS r FROM v)"
        )
    return f"WITH {V} " + " UNION ALL ".join(parts)


@query("chm_04_biowin", _bio_sql())
def _(spark, sf):
    b = RP.parse_biowin(report_files(spark, sf))
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"biowin{n}").alias("m")) for n in range(1, 7)])
    x = b.select("file", F.explode(models).alias("x"))
    return x.select(
        "file", F.col("x.model").alias("model"), rnd("x.m.total").alias("total"), rnd("x.m.probability").alias("probability"), rnd("x.m.rating").alias("rating"),
        F.col("x.m.time_category").alias("time_category"), F.col("x.m.printed").alias("printed"), F.size("x.m.fragments").alias("n_fragments"),
    )


@query(
    "chm_05_bcfbaf",
    f"""WITH {V} SELECT file, CAST(kow AS DOUBLE) AS log_bcf_regression, CAST(mw AS DOUBLE) AS bcf_regression_value, CAST(coef AS DOUBLE) AS biotrans_half_life_days,
        CAST(kow AS DOUBLE) AS log_kow_used, NULL::DOUBLE AS log_kow_experimental, CAST(kow AS DOUBLE) AS upper_log_bcf, CAST(mw AS DOUBLE) AS upper_baf, 10.5::DOUBLE AS mid_bcf,
        CAST(coef AS DOUBLE) AS upper_log_bcf_no_bio, 12.25::DOUBLE AS upper_bcf_no_bio, CAST(coef AS DOUBLE) AS log_kow_contribution, -1.5371::DOUBLE AS constant,
        brand || ' rule -0.150' AS corrections, 'Aliphatic alcohol [-OH]' AS item, n AS count, -1.0::DOUBLE AS table_result FROM v""",
)
def _(spark, sf):
    b = RP.parse_bcfbaf(report_files(spark, sf))
    return b.select(
        "file", "log_bcf_regression", "bcf_regression_value", "biotrans_half_life_days", "log_kow_used", "log_kow_experimental", "upper_log_bcf", "upper_baf",
        "mid_bcf", "upper_log_bcf_no_bio", "upper_bcf_no_bio", "log_kow_contribution", "constant", F.array_join("corrections", "; ").alias("corrections"),
        F.col("fragments")[0]["item"].alias("item"), F.col("fragments")[0]["count"].alias("count"), F.col("table_results")[0]["value"].alias("table_result"),
    )


@query(
    "chm_06_kocwin",
    f"""WITH {V} SELECT file, CAST(coef AS DOUBLE) AS mci_index, CAST(kow AS DOUBLE) AS log_koc_mci_non_corrected, CAST(kow AS DOUBLE) AS log_koc_mci_corrected, CAST(mw AS DOUBLE) AS koc_mci,
        'Ester (-C-CO-O-C-) or (HCO-O-C) x' || n || '; ' || brand || ' rule x1' AS mci_corrections, CAST(kow AS DOUBLE) AS log_kow_used,
        CAST(coef AS DOUBLE) AS log_koc_logkow_non_corrected, CAST(coef AS DOUBLE) AS log_koc_logkow_corrected, 1::DOUBLE AS koc_logkow, 0::INT AS n_logkow_corrections FROM v""",
)
def _(spark, sf):
    k = RP.parse_kocwin(report_files(spark, sf))
    text = F.array_join(F.transform("mci_corrections", lambda s: F.concat(s["item"], F.lit(" x"), s["count"].cast("string"))), "; ")
    return k.select(
        "file", "mci_index", "log_koc_mci_non_corrected", "log_koc_mci_corrected", "koc_mci", text.alias("mci_corrections"), "log_kow_used",
        "log_koc_logkow_non_corrected", "log_koc_logkow_corrected", "koc_logkow", F.size("logkow_corrections").alias("n_logkow_corrections"),
    )


@query(
    "chm_07_domain_verdicts",
    f"""WITH {V}, x AS (SELECT *, CAST(mw AS DOUBLE) AS w, CAST(kow AS DOUBLE) AS k, CAST(printf('%.4f', (size - 25) / 43.0) AS DOUBLE) + 0.01 - 0.05 + 3.1992 AS r3 FROM v),
        two AS (SELECT *, 1::INT AS ri FROM x UNION ALL SELECT *, 2 FROM x WHERE key % 5 = 0)
        SELECT file, ri AS record_index, w <= 991.15 AS kow_in, CASE WHEN w > 991.15 THEN 3 WHEN w > 719.92 THEN 2 ELSE 1 END + (abs(w - 199.98) > 3 * 199.98)::INT - (w > 991.15)::INT AS kow_warnings,
        CASE WHEN ri = 1 THEN w <= 697.7 AND n <= 3 END AS bio12_in, CASE WHEN ri = 1 THEN w <= 697.65 AND n <= 4 AND r3 BETWEEN 1.44 AND 3.89 END AS bio3_in,
        CASE WHEN ri = 1 THEN w <= 697.7 AND n <= 2 END AS bio56_in, CASE WHEN ri = 1 THEN w BETWEEN 68.08 AND 991.8 AND k BETWEEN -6.5 AND 11.26 END AS bcf_in,
        CASE WHEN ri = 1 THEN w BETWEEN 68.08 AND 959.17 AND k BETWEEN 0.31 AND 8.7 END AS baf_in, CASE WHEN ri = 1 THEN w BETWEEN 32.04 AND 665.02 AND n <= 2 END AS koc_in FROM two""",
)
def _(spark, sf):
    files = report_files(spark, sf)
    key = ["file", "record_index"]
    kow = RP.parse_kowwin(files).select(*key, D.kowwin_domain(F.col("mol_weight"), F.col("fragments")).alias("v")).select(
        *key, F.col("v.in_ad").alias("kow_in"), F.size("v.warnings").alias("kow_warnings"))
    bio = RP.parse_biowin(files)
    names = {"Biowin1_2": "bio12_in", "Biowin3": "bio3_in", "Biowin5_6": "bio56_in"}
    bio = bio.withColumns({f"chk_{g}": D.biowin_checked(g) for g in names})
    bio = bio.withColumns({n: D.biowin_group_domain(g, F.col("mol_weight"), F.col("metal_note"), F.col(f"chk_{g}"))["in_ad"] for g, n in names.items()})
    bcf = RP.parse_bcfbaf(files).select(
        *key, D.bcf_domain(F.col("mol_weight"), F.col("log_kow_used"), F.col("corrections"), F.col("metal_note"))["in_ad"].alias("bcf_in"),
        D.baf_domain(F.col("mol_weight"), F.col("log_kow_used"), F.col("fragments"), F.col("metal_note"))["in_ad"].alias("baf_in"))
    koc = RP.parse_kocwin(files).withColumns({f"chk_{c}": D.kocwin_checked(F.col(f"{c}_corrections")) for c in ("mci", "logkow")})
    koc = koc.select(*key, D.kocwin_domain(F.col("mol_weight"), F.col("chk_mci"), F.col("chk_logkow"), F.col("metal_note"))["in_ad"].alias("koc_in"))
    return kow.join(bio.select(*key, "bio12_in", "bio3_in", "bio56_in"), key, "full").join(bcf, key, "full").join(koc, key, "full")


@query(
    "chm_08_plausibility",
    """SELECT p_partkey, concat_ws('; ', CASE WHEN w < 16 THEN 'mass is implausibly low' WHEN w > 1000 THEN 'mass is implausibly high' END,
       CASE WHEN m < -200 OR m > 400 THEN 'melting point is implausible' END,
       CASE WHEN p_size > 20 THEN 'unusually many fragments' END) AS warnings, NULL::BOOLEAN AS in_ad
       FROM (SELECT p_partkey, p_size, p_retailprice - 890 AS w, p_size * 15.0::DOUBLE - 300 AS m FROM part)""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - 890).alias("w"), (F.col("p_size") * 15.0 - 300).alias("m"), "p_size")
    return D.plausibility(p, "w", "m", "p_size", "MP").select("p_partkey", F.array_join("warnings", "; ").alias("warnings"), "in_ad")


BASIC_SQL = f"""WITH {V}, two AS (SELECT *, 1::INT AS ri FROM v UNION ALL SELECT * REPLACE ('second compound' AS name), 2 FROM v WHERE key % 5 = 0),
  x AS (SELECT *, CAST(mw AS DOUBLE) AS w, CAST(printf('%.4f', (size - 25) / 43.0) AS DOUBLE) + 0.01 - 0.05 + 3.1992 AS r3,
    CAST(printf('%.4f', (size + 5) / 60.0) AS DOUBLE) AS p5, CAST(printf('%.4f', (size + 6) / 60.0) AS DOUBLE) AS p6 FROM two)
  SELECT file AS "Filename", ri::VARCHAR AS "Record_Index", name AS "Chemical_ID", {_smiles('size', 'key')} AS "SMILES", printf('%.4f', CAST(kow AS DOUBLE)) AS "KOWWIN_Log_Kow",
  CASE WHEN ri = 1 THEN printf('%.4f', r3) ELSE 'N/A' END AS "BIOWIN_Biowin3_Rating", CASE WHEN ri = 1 THEN 'Weeks-Months' ELSE 'N/A' END AS "BIOWIN_Biowin3_Prediction",
  CASE WHEN ri = 1 THEN printf('%.4f', p5) ELSE 'N/A' END AS "BIOWIN_Biowin5_Probability",
  CASE WHEN ri = 1 THEN CASE WHEN p6 >= 0.5 THEN 'Readily Degradable' ELSE 'NOT Readily Degradable' END ELSE 'N/A' END AS "BIOWIN_Biowin6_Prediction",
  CASE WHEN ri = 1 THEN printf('%.4f', CAST(kow AS DOUBLE)) ELSE 'N/A' END AS "BCFBAF_Log_BCF_Regression",
  CASE WHEN ri = 1 THEN printf('%.4f', CAST(kow AS DOUBLE)) ELSE 'N/A' END AS "KOCWIN_LogKoc_MCI_Corrected" FROM x"""


@query("src_13_basic_export", BASIC_SQL)
def _(spark, sf):
    t = D.basic_export(D.compound_table(report_files(spark, sf)))
    return t.select(
        "Filename", "Record_Index", "Chemical_ID", "SMILES", "KOWWIN_Log_Kow", "BIOWIN_Biowin3_Rating", "BIOWIN_Biowin3_Prediction", "BIOWIN_Biowin5_Probability",
        "BIOWIN_Biowin6_Prediction", "BCFBAF_Log_BCF_Regression", "KOCWIN_LogKoc_MCI_Corrected",
    )


TABLE_SQL = f"""{V}, two AS (SELECT *, 1::INT AS ri FROM v UNION ALL SELECT * REPLACE ('second compound' AS name), 2 FROM v WHERE key % 5 = 0)"""
FIRST = lambda sql, name: f'CASE WHEN ri = 1 THEN {sql} END AS "{name}"'


@query(
    "chm_09_compound_table",
    f"""WITH {TABLE_SQL} SELECT file AS "Filename", ri AS "Record_Index", name AS "Chemical_ID", {FIRST("CASE WHEN salt THEN 'NOTE: METAL (Na) HAS BEEN REMOVED to allow estimation' ELSE 'None' END", "BIOWIN_Metal_Note")},
        {FIRST("'Ester [-C(=O)-O-C]: ' || n || ', ' || brand || ' [unlisted]: 1'", "BIOWIN_Fragment_Summary")}, {FIRST("brand || ' rule -0.150'", "BCFBAF_BCF_Corrections")},
        {FIRST("'Ester (-C-CO-O-C-) or (HCO-O-C) (count ' || n || '); ' || brand || ' rule (count 1)'", "KOCWIN_MCI_Corrections")}, {FIRST("'None'", "KOCWIN_LogKow_Corrections")},
        {FIRST("'-1.0000'", "BCFBAF_Log_Bio_Half_Life")} FROM two""",
)
def _(spark, sf):
    t = D.compound_table(report_files(spark, sf))
    one_space = lambda c: F.regexp_replace(c, r" +", " ").alias(c)
    return t.select(
        "Filename", "Record_Index", "Chemical_ID", "BIOWIN_Metal_Note", one_space("BIOWIN_Fragment_Summary"), "BCFBAF_BCF_Corrections", "KOCWIN_MCI_Corrections",
        "KOCWIN_LogKow_Corrections", "BCFBAF_Log_Bio_Half_Life",
    )


FOUR = lambda sql: f"printf('%.4f', CAST({sql} AS DOUBLE))"


@query(
    "src_13_advanced_export",
    f"""WITH {TABLE_SQL} SELECT file AS "Filename", ri AS "Record_Index", name AS "Chemical_ID", {_smiles('size', 'key')} AS "SMILES", 'C' || size || ' H10' AS "Molecular_Formula", CAST(mw AS DOUBLE) AS "Molecular_Weight",
        {FOUR("kow")} AS "KOWWIN_Log_Kow", {FIRST(FOUR("kow"), "BCFBAF_Log_BCF_Regression")}, {FIRST(FOUR("mw"), "BCFBAF_BCF_Regression_L_per_kg")}, {FIRST(FOUR("kow"), "BCFBAF_Log_BAF_Upper_Trophic")},
        {FIRST(FOUR("mw"), "BCFBAF_BAF_Upper_Trophic_L_per_kg")}, {FIRST(FOUR("coef"), "BCFBAF_Biotrans_Half_Life_Days")}, {FIRST(FOUR("kow"), "BCFBAF_LogKow_Used")}, {FIRST("'N/A'", "BCFBAF_LogKow_Experimental")},
        {FIRST(FOUR("kow"), "BCFBAF_ArnotGobas_UPPER_TROPHIC_LOG_BCF")}, {FIRST(FOUR("coef"), "BCFBAF_ArnotGobas_MID_TROPHIC_LOG_BCF")}, {FIRST("'12.2500'", "BCFBAF_ArnotGobas_UPPER_TROPHIC_BCF_NO_BIO")},
        {FIRST(FOUR("coef"), "KOCWIN_MCI_Index")}, {FIRST(FOUR("kow"), "KOCWIN_LogKoc_MCI_NonCorrected")}, {FIRST(FOUR("mw"), "KOCWIN_Koc_MCI_L_per_kg")}, {FIRST(FOUR("kow"), "KOCWIN_LogKow_Input")},
        {FIRST(FOUR("coef"), "KOCWIN_LogKoc_LogKow_Corrected")}, false AS has_empty_column FROM two""",
)
def _(spark, sf):
    """All columns are worked out; those whose values plain SQL can state are compared."""
    t = D.advanced_export(D.compound_table(report_files(spark, sf)))
    names = [*D.BASIC_COLUMNS[:6], "KOWWIN_Log_Kow", *[f"BCFBAF_{c}" for c in (
        "Log_BCF_Regression", "BCF_Regression_L_per_kg", "Log_BAF_Upper_Trophic", "BAF_Upper_Trophic_L_per_kg", "Biotrans_Half_Life_Days", "LogKow_Used", "LogKow_Experimental",
        "ArnotGobas_UPPER_TROPHIC_LOG_BCF", "ArnotGobas_MID_TROPHIC_LOG_BCF", "ArnotGobas_UPPER_TROPHIC_BCF_NO_BIO",
    )], *[f"KOCWIN_{c}" for c in ("MCI_Index", "LogKoc_MCI_NonCorrected", "Koc_MCI_L_per_kg", "LogKow_Input", "LogKoc_LogKow_Corrected")]]
    return t.select(*names, F.lit("BCFBAF_ArnotGobas_LOWER_TROPHIC_BCF" in t.columns).alias("has_empty_column"))


@query(
    "jon_07_align_records",
    """SELECT coalesce(d.doc_id, l.doc_id) AS id, coalesce(d.lang, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END) AS tag, d.source AS a__source, l.toxic AS b__toxic
       FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id AS id", "lang AS tag", "source")
    l = table(spark, sf, "labels").selectExpr("doc_id AS id", "CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS tag", "toxic")
    return align_records({"a": d, "b": l}, ["id"], ["tag"])


# ------------------------------------------------------------------ scalar bands


@query(
    "sca_17_viability_band",
    """SELECT event_id, CASE WHEN value >= 80 THEN 'Low toxicity - cells largely viable' WHEN value >= 50 THEN 'Moderate toxicity - significant cell death'
       WHEN value >= 20 THEN 'High toxicity - majority of cells affected' ELSE 'Severe toxicity - extensive cell death' END AS band FROM events""",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", SC.viability_band(F.col("value")).alias("band"))


@query(
    "sca_18_time_category",
    """SELECT event_id, CASE WHEN r > 4.75 THEN 'Hours' WHEN r > 4.25 THEN 'Hours to Days' WHEN r > 3.75 THEN 'Days' WHEN r > 3.25 THEN 'Days to Weeks' WHEN r > 2.75 THEN 'Weeks'
       WHEN r > 2.25 THEN 'Weeks to Months' WHEN r > 1.75 THEN 'Months' ELSE 'Recalcitrant' END AS category FROM (SELECT event_id, value / 20 AS r FROM events)""",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", SC.time_category(F.col("value") / 20).alias("category"))


@query(
    "sca_19_logistic",
    f"SELECT c_custkey, {R('1 / (1 + exp(-x))', 9)} AS p, {R('CASE WHEN q > 0 AND q < 1 THEN ln(q / (1 - q)) END', 7)} AS l FROM (SELECT c_custkey, c_acctbal / 1000 AS x, c_acctbal / 5000 AS q FROM customer)",
)
def _(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", rnd(SC.logistic(b / 1000), 9).alias("p"), rnd(SC.logit(b / 5000), 7).alias("l"))


# ------------------------------------------------------------------ batch scoring

RAW_BATCH = """b AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Sphere' WHEN 1 THEN 'Lentil' WHEN 2 THEN 'Irregular' ELSE 'Cube' END AS shape, 'Yes' AS anatase, 'No' AS rutile,
  CASE WHEN c_custkey % 10 = 9 THEN 'x' ELSE printf('%.1f', (c_custkey % 120)::DOUBLE) END AS diameter, 'A549' AS cell, (c_nationkey * 3)::VARCHAR AS t, 'MTT' AS assay, printf('%.2f', floor(c_acctbal) / 4) AS conc FROM customer)"""


def raw_batch(spark, sf):
    """A table under the header spellings users write, derived from ``customer``."""
    k = F.col("c_custkey")
    shape = F.when(k % 4 == 0, "Sphere").when(k % 4 == 1, "Lentil").when(k % 4 == 2, "Irregular").otherwise("Cube")
    return table(spark, sf, "customer").select(
        k, shape.alias("SHAPE"), F.lit("Yes").alias("anatase"), F.lit("No").alias(" Rutile"),
        F.when(k % 10 == 9, "x").otherwise(F.format_string("%.1f", (k % 120).cast("double"))).alias("Diameter_nm"), F.lit("A549").alias("celltype"),
        (F.col("c_nationkey") * 3).cast("string").alias("exposure_time"), F.lit("MTT").alias("assay"), F.format_string("%.2f", F.floor("c_acctbal") / 4).alias("conc"),
    )


# A made-up additive model: the trained one is not public.
MODEL = SC.AdditiveModel(
    60.0,
    {"Shape": {"Sphere": 5.0, "Irregular": -3.0, "Lentil": 1.0}, SC.DIAMETER: ([20.0, 50.0], [-8.0, 0.0, 4.0]), "log_conc": ([0.5, 1.0, 1.5, 2.0], [20.0, 8.0, -5.0, -20.0, -40.0])},
)
SCORE_SQL = """CASE shape WHEN 'Sphere' THEN 5 WHEN 'Irregular' THEN -3 WHEN 'Lentil' THEN 1 ELSE 0 END AS s, CASE WHEN d IS NULL THEN 0 WHEN d < 20 THEN -8 WHEN d < 50 THEN 0 ELSE 4 END AS z,
  CASE WHEN lc < 0.5 THEN 20 WHEN lc < 1 THEN 8 WHEN lc < 1.5 THEN -5 WHEN lc < 2 THEN -20 ELSE -40 END AS c"""
BATCH_TERMS = f"""p AS (SELECT *, TRY_CAST(diameter AS DOUBLE) AS d, TRY_CAST(t AS DOUBLE) AS h, CAST(conc AS DOUBLE) AS cc FROM b),
  q AS (SELECT *, CASE WHEN cc > 0 THEN log10(cc) ELSE 0 END AS lc FROM p), s AS (SELECT *, {SCORE_SQL} FROM q)"""


def scored_batch(spark, sf):
    b = SC.prepare_batch(raw_batch(spark, sf))
    return b.withColumn("log_conc", SC.log_concentration(F.col(f"`{SC.CONCENTRATION}`")))


@query(
    "chm_11_batch_scoring",
    f"""WITH {RAW_BATCH}, {BATCH_TERMS}, e AS (SELECT *, concat_ws('; ', CASE WHEN shape = 'Cube' THEN 'Invalid Shape value: Cube' END,
          CASE WHEN d IS NULL THEN 'Diameter (nm) must be a valid number' END, CASE WHEN d < 5 OR d > 100 THEN 'Diameter (nm) must be between 5 and 100' END,
          CASE WHEN h < 3 OR h > 72 THEN 'Time (hr) must be between 3 and 72' END, CASE WHEN cc < 0.01 OR cc > 1000 THEN 'Concentration (ug/ml) must be between 0.01 and 1000' END) AS errors FROM s)
        SELECT c_custkey, errors, errors = '' AS is_valid, CASE WHEN errors = '' THEN round((60 + s + z + c)::DOUBLE, 2) END AS prediction FROM e""",
)
def _(spark, sf):
    b = scored_batch(spark, sf)
    return b.select("c_custkey", F.array_join("errors", "; ").alias("errors"), "is_valid", F.when(F.col("is_valid"), F.round(MODEL.score(), 2)).alias("prediction"))


@query(
    "chm_12_contributions",
    f"""WITH {RAW_BATCH}, {BATCH_TERMS} SELECT c_custkey, 'Shape' AS feature, s::DOUBLE AS contribution FROM s UNION ALL SELECT c_custkey, 'Diameter (nm)', z::DOUBLE FROM s
        UNION ALL SELECT c_custkey, 'log_conc', c::DOUBLE FROM s""",
)
def _(spark, sf):
    return MODEL.contributions(scored_batch(spark, sf), ["c_custkey"])


@query(
    "chm_12_importance",
    f"""WITH {RAW_BATCH}, {BATCH_TERMS} SELECT 'Shape' AS feature, {R('avg(abs(s))', 8)} AS importance FROM s UNION ALL SELECT 'Diameter (nm)', {R('avg(abs(z))', 8)} FROM s
        UNION ALL SELECT 'log_conc', {R('avg(abs(c))', 8)} FROM s""",
)
def _(spark, sf):
    return MODEL.importance(scored_batch(spark, sf)).withColumn("importance", rnd("importance", 8))


@query("udf_02_predict_batch", f"WITH {RAW_BATCH}, {BATCH_TERMS} SELECT c_custkey, {R('2 * lc + 1', 7)} AS prediction FROM s")
def _(spark, sf):
    p = SC.predict_batch(scored_batch(spark, sf), lambda pdf: 2 * pdf["log_conc"] + 1, keep=["c_custkey", "log_conc"])
    return p.select("c_custkey", rnd("prediction", 7).alias("prediction"))


def _grid(step: str) -> str:
    return f"g AS (SELECT p_partkey, p_size, 10 ** (i * {step}) AS conc FROM part, range(50) t(i))"


@query(
    "chm_10_concentration_grid",
    f"WITH {_grid('3.0::DOUBLE / 49')} SELECT p_partkey, {R('conc', 6)} AS conc, {R('100 - p_size * ln(conc + 1) / 4', 6)} AS viability FROM g",
)
def _(spark, sf):
    g = SC.concentration_grid(table(spark, sf, "part").select("p_partkey", "p_size"), out="conc")
    return g.select("p_partkey", rnd("conc", 6).alias("conc"), rnd(100 - F.col("p_size") * F.ln(F.col("conc") + 1) / 4, 6).alias("viability"))


@query(
    "win_06_half_response",
    f"""WITH {_grid('3.0::DOUBLE / 49')}, v AS (SELECT p_partkey, conc, 100 - p_size * ln(conc + 1) / 4 AS v FROM g),
        n AS (SELECT *, lead(v) OVER w AS v2, lead(conc) OVER w AS c2 FROM v WINDOW w AS (PARTITION BY p_partkey ORDER BY conc))
        SELECT p_partkey, {R('arg_min(conc + (50 - v) * (c2 - conc) / (v2 - v), conc) FILTER (WHERE v >= 50 AND v2 < 50)', 6)} AS ic50 FROM n GROUP BY 1""",
)
def _(spark, sf):
    g = SC.concentration_grid(table(spark, sf, "part").select("p_partkey", "p_size"), out="conc")
    g = g.withColumn("v", 100 - F.col("p_size") * F.ln(F.col("conc") + 1) / 4)
    return SC.half_response(g, ["p_partkey"], "conc", "v").withColumn("ic50", rnd("ic50", 6))


# ------------------------------------------------------------------ search sheets


def sheets(spark, sf):
    """Three search sheets derived from ``documents``: section = language, subsection = source."""
    d = table(spark, sf, "documents").select(
        F.col("lang").alias("Section"), F.col("source").alias("Subsection"), (F.col("doc_id") % 50).cast("string").alias("Name"), "doc_id",
    )
    f = lambda tag: F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit(f"{tag}("), F.col("doc_id").cast("string"), F.lit(")")))
    pub = d.withColumn("Formula", f("p"))
    wos = d.where("doc_id % 3 <> 0").withColumn("Formula", f("TS="))
    sco = d.where("doc_id % 4 <> 0").withColumn("Formula", F.when(F.col("Section") == "en", f("TITLE-ABS-KEY")).otherwise(f("x")))
    return pub, wos, sco


KEYS = ["Section", "Subsection", "Name"]


def _first(pred: str, formula: str) -> str:
    return f"""(SELECT lang, source, (doc_id % 50)::VARCHAR AS name, arg_min(CASE WHEN doc_id % 7 = 0 THEN '' ELSE {formula} END, doc_id) AS f FROM documents WHERE {pred} GROUP BY 1, 2, 3)"""


@query(
    "jon_06_first_match",
    f"""SELECT doc_id, d.lang AS "Section", d.source AS "Subsection", (doc_id % 50)::VARCHAR AS "Name", w.f AS wos_Formula, s.f AS sco_Formula FROM documents d
        LEFT JOIN {_first('doc_id % 3 <> 0', "'TS=(' || doc_id || ')'")} w ON w.lang = d.lang AND w.source = d.source AND w.name = (doc_id % 50)::VARCHAR
        LEFT JOIN {_first('doc_id % 4 <> 0', "CASE WHEN lang = 'en' THEN 'TITLE-ABS-KEY(' || doc_id || ')' ELSE 'x(' || doc_id || ')' END")} s
        ON s.lang = d.lang AND s.source = d.source AND s.name = (doc_id % 50)::VARCHAR""",
)
def _(spark, sf):
    pub, wos, sco = sheets(spark, sf)
    return first_match_join(pub.drop("Formula"), {"wos": wos, "sco": sco}, KEYS, "doc_id", ["Formula"])


@query(
    "agg_12_combine_formulas",
    """SELECT lang AS "Section", source AS "Subsection", string_agg('(p(' || doc_id || '))', ' OR ' ORDER BY doc_id) FILTER (WHERE doc_id % 7 <> 0) AS combined FROM documents GROUP BY 1, 2""",
)
def _(spark, sf):
    pub, _w, _s = sheets(spark, sf)
    return SH.combine(pub, ["Section", "Subsection"], "doc_id", "Formula")


@query(
    "agg_13_hoisted_prefix",
    """SELECT lang AS "Section", source AS "Subsection", CASE WHEN lang = 'en' THEN 'TITLE-ABS-KEY(' || string_agg('(' || doc_id || ')', ' OR ' ORDER BY doc_id) FILTER (WHERE doc_id % 7 <> 0) || ')'
       ELSE string_agg('(x(' || doc_id || '))', ' OR ' ORDER BY doc_id) FILTER (WHERE doc_id % 7 <> 0) END AS combined FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    _p, _w, sco = sheets(spark, sf)
    return SH.combine(sco, ["Section", "Subsection"], "doc_id", "Formula", SH.TITLE_PREFIXES)


@query(
    "chm_13_missing_formulas",
    """WITH f AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '"' || p_name || 's"[tiab] OR ' || p_type END AS pub, CASE WHEN p_partkey % 2 = 0 THEN 'kept' ELSE '' END AS wos FROM part),
       c AS (SELECT *, CASE WHEN pub <> '' THEN replace(pub, '[tiab]', '') ELSE '' END AS derived FROM f WHERE pub = '' OR wos = '')
       SELECT p_partkey, p_name AS name, pub, derived AS wos, derived AS sco, pub = '' AS failed, CASE WHEN pub <> '' THEN p_name || 's' END AS corrected FROM c""",
)
def _(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit('s"[tiab] OR '), F.col("p_type"))).alias("pub"),
        F.when(k % 2 == 0, "kept").otherwise("").alias("wos"),
    )
    todo = d.where(SH.needs_formula("pub", "wos"))
    return SH.derive_formulas(todo, "name", "pub", "wos", "sco").select("p_partkey", "name", "pub", "wos", "sco", "failed", "corrected")


# ------------------------------------------------------------------ group definitions


def group_files(spark, sf):
    """Group-definition text per document: words of the text as items of two groups."""
    found = F.filter(F.split(F.regexp_replace("text", r"[^a-z]+", " "), " "), lambda w: w != "")
    words = F.col("words")
    half = F.floor(F.size(words) / 2).cast("int")
    block = lambda head, items: F.concat(head, F.lit("\n\nName\n"), F.array_join(items, "\n"), F.lit("\n\n"))
    text = F.concat(
        F.lit("comment line\n"), block(F.concat(F.lit("1. Group "), F.col("lang")), F.slice(words, F.lit(1), half)),
        block(F.concat(F.lit("22. From "), F.col("source")), F.slice(words, half + 1, F.size(words))),
    )
    docs = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", "lang", "source", found.alias("words"))  # split once
    return docs.select(F.col("doc_id").cast("string").alias("file"), text.alias("content"))


WORDS = """w AS (SELECT doc_id, lang, source, list_filter(string_split(regexp_replace(text, '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
  h AS (SELECT *, len(ws) // 2 AS half FROM w),
  g AS (SELECT doc_id::VARCHAR AS file, '1' AS group_id, 'Group ' || lang AS group_name, ws[1:half] AS items FROM h
        UNION ALL SELECT doc_id::VARCHAR, '22', 'From ' || source, ws[half + 1:] FROM h)"""


@query(
    "src_09_group_definitions",
    f"""WITH {WORDS} SELECT file, group_id, group_name, unnest(items) AS descriptor, unnest(range(len(items)))::INT AS item_no FROM g WHERE len(items) > 0
        UNION ALL SELECT file, group_id, group_name, NULL, NULL FROM g WHERE len(items) = 0""",
)
def _(spark, sf):
    return RD.parse_groups(group_files(spark, sf)).select("file", "group_id", "group_name", "descriptor", "item_no")


@query(
    "agg_14_group_summary",
    """WITH p AS (SELECT DISTINCT n_regionkey AS id, r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey), g AS (SELECT id, r_name, count(*) AS n FROM p GROUP BY 1, 2)
       SELECT count(*) AS n_groups, sum(n)::BIGINT AS total_descriptors, string_agg(r_name, '; ' ORDER BY id) AS names FROM g""",
)
def _(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    g = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_regionkey").cast("string").alias("group_id"), F.col("r_name").alias("group_name"), F.col("n_name").alias("descriptor"))
    return RD.group_summary(g)


@query(
    "win_07_header_carry",
    f"WITH {WORDS} SELECT file, group_name, len(items)::BIGINT AS n_items FROM g",
)
def _(spark, sf):
    """Every line belongs to the last header above it: lines per header."""
    return RD.parse_groups(group_files(spark, sf)).groupBy("file", "group_name").agg(F.count("descriptor").alias("n_items"))
