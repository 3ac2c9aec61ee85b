"""Numbers in text, keys, rules, reports, sheets and scoring on hand-made fixtures."""

import pathlib
import re
import time

import pytest
from pyspark.sql import functions as F

from assaylake.functions import text as X
from assaylake.operators import domain as D
from assaylake.operators import keyjoin as K
from assaylake.operators import reports as RP
from assaylake.operators import rules as RU
from assaylake.operators import scoring as SC
from assaylake.operators import sheets as SH
from assaylake.plans import QUERIES
from assaylake.plans.reports import report_files
from assaylake.session import stage_root
from assaylake.sources import readers as RD


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_number_forms(spark):
    forms = ["1,98", "1 234", "1'234", "1.234,56", "12%", "(5)", "NA", "1.234", "-3,5", "1 000", "+2.5", "1d", "abc", None, "2e3"]
    want = [1.98, 1234.0, 1234.0, 1234.56, 0.12, -5.0, None, 1234.0, -3.5, 1000.0, 2.5, None, None, None, 2000.0]
    assert column(spark, forms, X.number_from_text) == want
    assert column(spark, ["1.234"], lambda c: X.number_from_text(c, decimal_mark=".")) == [1.234]


def test_leading_zero_ids_stay_text(spark):
    df = spark.createDataFrame([("0012", "1,5"), ("0013", "x"), ("7", "y"), ("0014", "z")], "id string, v string")
    assert X.numeric_text_columns(df) == {"v": "number"}
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("x", "c"), ("y", "3")], "few string, none string")
    assert X.numeric_text_columns(df) == {"few": "number"}


def test_keys(spark):
    forms = ["1", "1.0", "1,0", " 1 ", " 1 ", "0012", "", "nan", "N/A", "1.25", "0.1", "0.00001", "ID-7", "3e2", None, "-4.0"]
    want = ["1", "1", "1", "1", "1", "0012", None, None, None, "1.25", "0.1", "1e-05", "ID-7", "300", None, "-4"]
    assert column(spark, forms, X.normalise_key) == want
    df = spark.createDataFrame([(v,) for v in forms], "v string")
    got = [r["k"] for r in X.with_keys(df, {"k": "v"}).collect()]
    assert got == want


def test_join_with_duplicate_and_missing_keys(spark):
    main = spark.createDataFrame([(1, "1"), (2, "2.0"), (3, "nan"), (4, "9")], "row int, key string")
    side = spark.createDataFrame([("1.0", "2,0"), ("1", "4,0"), ("2", "5"), ("nan", "7")], "key string, v string")
    got = {r["row"]: r["v"] for r in K.attach_by_key(main, side, "key", "v").collect()}
    assert got == {1: 3.0, 2: 5.0, 3: None, 4: None}
    cats = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "b"), ("2", None)], "key string, v string")
    got = {r["row"]: r["v"] for r in K.attach_by_key(main, cats, "key", "v").collect()}
    assert got[1] == "b" and got[2] is None


def test_search_text(spark):
    assert column(spark, ["a<THINK>x\ny</think> b", "[thinking]q[/thinking]z"], X.strip_reasoning) == ["a b", "z"]
    assert column(spark, ["a[tiab] OR b[MeSH Terms][x]"], X.strip_field_tags) == ["a OR b[x]"]
    assert column(spark, ['("one two"[tw])', "(alpha[tiab] OR beta)", "plain"], X.main_term) == ["one two", "alpha", ""]
    long = " OR ".join(['"aaaaaaa"'] * 10)
    assert column(spark, [long, "short OR short", " OR ".join(f"term{i}" for i in range(12))], X.is_repetitive) == [True, False, False]
    df = spark.createDataFrame([("oxidative stres", "oxidative stress"), ("same", "SAME"), ("a long concept name", "concept")], "a string, b string")
    assert [r[0] for r in df.select(X.is_spelling_fix(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_combined_formulas(spark):
    rows = [("all", 1, "TS=(a)"), ("all", 2, "(TS=(b OR c))"), ("all", 3, " "), ("mixed", 1, "TS=(a)"), ("mixed", 2, "TI=(b)"), ("empty", 1, "")]
    df = spark.createDataFrame(rows, "g string, n int, f string")
    got = {r["g"]: r["combined"] for r in SH.combine(df, ["g"], "n", "f", SH.TOPIC_PREFIXES).collect()}
    assert got == {"all": "TS=((a) OR (b OR c))", "mixed": "(TS=(a)) OR (TI=(b))", "empty": None}


def test_groups_file(spark):
    text = "1. Constitutional indices\n\nName\nMW\nAMW\n\n2. Topological indices\n\nName\nW\n\n3. Empty\n"
    df = spark.createDataFrame([("f", text)], "file string, content string")
    rows = [(r["group_id"], r["group_name"], r["item_no"], r["descriptor"]) for r in RD.parse_groups(df).orderBy("group_id", "item_no").collect()]
    assert rows == [
        ("1", "Constitutional indices", 0, "MW"), ("1", "Constitutional indices", 1, "AMW"), ("2", "Topological indices", 0, "W"), ("3", "Empty", None, None),
    ]


def test_groups_file_is_cut_once(spark):
    df = spark.createDataFrame([("f", "x\n 1. A\t\nName\n  b  c \nName\n\n\n22. B\n"), ("g", ""), ("h", None)], "file string, content string")
    groups = RD.parse_groups(df)
    assert {tuple(r) for r in groups.collect()} == {("f", "1", "A", 0, "b  c"), ("f", "22", "B", None, None)}
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("split(") == 3  # lines, groups, lines of a group


def test_probes(spark, tmp_path):
    for name, last, want in (("a", "zażółć".encode(), "utf-8"), ("b", "über".encode("latin1"), "latin1"), ("c", b"plain", "utf-8")):
        (tmp_path / name).write_bytes(b"id,text\n" + b"1,plain ascii\n" * 9000 + b"2," + last + b"\n")
        assert RD.probe_encoding(spark, str(tmp_path / name)) == want
    (tmp_path / "q.csv").write_text('id,text\n1,"say ""hi"", you"\n2,"two\nlines"\n')
    assert [r["text"] for r in RD.read_csv(spark, str(tmp_path / "q.csv"), "id int, text string").orderBy("id").collect()] == ['say "hi", you', "two\nlines"]
    assert RD.read_csv_probed(spark, str(tmp_path / "b"), "id int, text string").where("id = 2").first()["text"] == "über"
    assert RD.probe_separator("a\tb") == "\t" and RD.probe_separator("a,b\tc") == ","
    assert RD.clean_names(["a\r\nb ", " c"]) == ["a b", "c"]


REPORT = """SMILES : CCO
     CCN
CHEM   : Long name
     wrapped
MOL FOR: C4 H11 N1 O1
MOL WT : 89.14
KOWWIN Program (v1.68) Results:
   Log Kow(version 1.68 estimate): -0.45
-------+-----+------------+---------+--------
 TYPE  | NUM | LOGKOW FRAGMENT DESCRIPTION | COEFF | VALUE
-------+-----+------------+---------+--------
 Frag  |  2  |  -CH2-   [aliphatic] | 0.4911 | 0.9822
 Const |     |  Equation Constant   |        | 0.2290
-------+-----+------------+---------+--------
BIOWIN (v4.10) Program Results:
SMILES : CCO
MOL WT : 1,089.14
NOTE:  METAL (Na)  HAS BEEN REMOVED

   Biowin6 (MITI Non-Linear): Readily Degradable
------+-----+------+---------+---------
 TYPE | NUM | Biowin6 FRAGMENT DESCRIPTION | COEFF | VALUE
 Frag |  1  | Methyl  [-CH3] | 0.0194 | 0.0194
 Frag |  1  | Methyl [-CH3]  | 0.0194 | 0.0194
============+======+
   RESULT   | Biowin6 | | 0.7500
============+======+
SMILES : second
MOL WT : 10.5
KOWWIN Program (v1.68) Results:
   Log Kow  =  1.25
"""


def test_report_records(spark):
    files = spark.createDataFrame([("a.txt", REPORT)], "file string, content string")
    k = RP.parse_kowwin(files).orderBy("record_index").collect()
    assert [r["smiles"] for r in k] == ["CCOCCN", "second"]
    assert k[0]["chem_id"] == "Long name wrapped" and k[0]["mol_weight"] == 89.14 and k[0]["log_kow"] == -0.45 and k[1]["log_kow"] == 1.25
    assert [(f["type"], f["count"], f["item"]) for f in k[0]["fragments"]] == [("Frag", 2, "-CH2- [aliphatic]")] and k[1]["fragments"] == []
    b = RP.parse_biowin(files).collect()
    assert len(b) == 1 and b[0]["mol_weight"] == 10.5 and b[0]["biowin1"] is None
    m = b[0]["biowin6"]
    assert m["probability"] == 0.75 and m["printed"] == "Readily Degradable" and abs(m["total"] - 1.0986123) < 1e-6
    assert b[0]["metal_note"] == "NOTE: METAL (Na) HAS BEEN REMOVED"
    t = D.compound_table(files).orderBy("Record_Index").collect()
    assert len(t) == 2
    assert t[0]["BIOWIN_Biowin6_Prediction"] == "Readily Degradable" and t[0]["BIOWIN_Fragment_Summary"] == "Methyl  [-CH3]: 1"
    assert t[0]["KOWWIN_Log_Kow"] == "-0.4500" and t[1]["BIOWIN_AD_Status"] is None and t[0]["BCFBAF_AD_Status"] is None
    assert t[0]["BIOWIN_Biowin12_Evaluated"] == "No" and t[0]["BIOWIN_Biowin56_AD_Status"] == "OUT OF AD: Biowin 5-6"
    basic = D.basic_export(D.compound_table(files)).where("Record_Index = '2'").first()
    assert basic["KOCWIN_AD_Status"] == "N/A" and basic["KOWWIN_Log_Kow"] == "1.2500"


def test_domain_messages(spark):
    df = spark.createDataFrame([(10.0,), (100.0,), (800.0,), (1000.0,), (None,)], "w double")
    v = df.select(D.kowwin_domain(F.col("w"), F.array().cast("array<struct<item:string,count:int>>")).alias("v")).select("v.*").collect()
    assert [r["in_ad"] for r in v] == [False, True, True, False, False]
    assert v[1]["status"] == "IN AD" and v[2]["status"] == "IN AD (with caution): validation range"
    assert v[3]["status"] == "OUT OF AD: mass" and len(v[3]["warnings"]) == 2
    items = spark.createDataFrame([([("Nitro (-NO2)", 3), ("odd", 1)],)], "m array<struct<item:string,count:int>>")
    k = items.select(D.kocwin_domain(F.lit(200.0), D.kocwin_checked(F.col("m")), D.kocwin_checked(F.col("m")), F.lit(None).cast("string")).alias("v")).select("v.*").first()
    assert not k["in_ad"] and "MCI correction over its limit of 2: Nitro (-NO2) x3" in k["warnings"]


def test_domain_verdicts_look_at_both_kinds_of_corrections(spark, tmp_path):
    """Corrections of the connectivity estimate: 2 of an ester are within the limit, 3 are not; a wrong weight decides alone."""
    rows = [(1, 1, "in", "Brand#1", 400.0), (2, 2, "over", "Brand#1", 400.0), (5, 1, "heavy", "Brand#1", 4000.0)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int, p_name string, p_brand string, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["file"], r["record_index"]): r["koc_in"] for r in QUERIES["chm_07_domain_verdicts"](spark, str(tmp_path)).collect()}
    assert got == {("part-1.txt", 1): True, ("part-2.txt", 1): False, ("part-5.txt", 1): False, ("part-5.txt", 2): None}


def test_rules_and_validation(spark):
    df = spark.createDataFrame([("Cube", "Yes", "No", "30", "A549", "24", "MTT", "abc"), ("Sphere", "Yes", None, "30", "A549", "24", "MTT", "1")],
                               ["shape", "Anatase", "rutile", "diameter", "celltype", "time", "assay", "conc"])
    got = SC.prepare_batch(df).collect()
    assert got[0]["errors"] == ["Invalid Shape value: Cube", "Concentration (ug/ml) must be a valid number"]
    assert got[1]["errors"] == ["Missing required field: Rutile"] and not got[1]["is_valid"]
    rule = RU.RangeRule("x", 1.0, 5.0, "low", "high")
    frame = RU.rules_frame(spark, {"s": [rule]})
    back = RU.load_rules(frame, "s")
    assert back == [rule]
    xs = spark.createDataFrame([(0.0,), (3.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in xs.select(RU.range_messages(back)).collect()] == [["low"], [], ["high"], []]


def test_half_response(spark):
    rows = [("falling", c, v) for c, v in ((1.0, 90.0), (10.0, 60.0), (100.0, 40.0))] + [("flat", 1.0, 80.0), ("flat", 2.0, 80.0)] + [("rising", 1.0, 20.0), ("rising", 2.0, 80.0)]
    df = spark.createDataFrame(rows, "id string, c double, v double")
    got = {r["id"]: r["ic50"] for r in SC.half_response(df, ["id"], "c", "v").collect()}
    assert got == {"falling": 55.0, "flat": None, "rising": None}


def kow_report(n, short=False):
    """``n`` KOWWIN sections, each named by the text in front of its header."""
    gap = "" if short else "x" * 40 + "\n"
    return "".join(f"SMILES : C{k}\nCHEM   : name {k}\nMOL FOR: C1\nMOL WT : {k}.5\n{gap}KOWWIN Program (v1.68) Results:\n   Log Kow(version 1.68 estimate): {k}.25\n{gap}" for k in range(n))


def test_blanks_are_trimmed_in_linear_work(spark):
    forms = [" a\t\n", "\u2003a ", "", "  ", "a \u0085", "a \u0085 ", None, "a" + " " * 400_000 + "b "]
    begin = time.monotonic()
    got = column(spark, forms, X.strip_all)
    assert time.monotonic() - begin < 60
    assert got == ["a", "\u2003a", "", "", "a\u0085", "a \u0085", None, "a" + " " * 400_000 + "b"]


def test_sections_of_mixed_lengths_equal_plain_cutting(spark):
    header = "KOWWIN Program"
    pieces = ["head é"] + [header + "x" * n for n in (0, 5, 2000, 0, *[0] * 90, 300, 700, 999, 1, 986, 40, 0)]
    texts = {"a": "".join(pieces), "b": "".join(pieces[1:]), "c": "none", "d": "", "e": "m\u0001" + header, "f": None}
    got = RP.sections(spark.createDataFrame(list(texts.items()), "file string, content string"), "KOWWIN").collect()
    want = set()
    for file, text in texts.items():
        text = (text or "").replace("\u0001", " ")
        starts = [m.start() for m in re.finditer(header, text)]
        for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(text)]), 1):
            want.add((file, k, text[:a][-1000:], text[a:z]))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_field_values_end_where_their_lines_do(spark):
    values = ["CCO\nNEXT", "CC \n  O\n\nX : 1", "A\n \t\n\n  B\nC", "A  \nB", "A\n\n\nB\n", "", "A\n\x0b\nB", "A\r\nB", "A\n\r\n B\n"]
    texts = ["SMILES : x\nSMILES : " + v for v in values]

    def plain(text):
        value = re.split(r"SMILES\s*:\s*", text)[-1]
        return re.split(r"(?<!\n)\n(?=\S)", re.sub(r"\n[ \t\r]+(?=\n)", "\n", value), maxsplit=1)[0]

    assert column(spark, texts, lambda c: RP.raw_field(c, "SMILES")) == [plain(t) for t in texts]


def test_report_parsers_search_texts_once(spark):
    """Each field pattern stands once in the plan, not once per use of its value."""
    files = spark.createDataFrame([("f", "")], "file string, content string")
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert text(RP.parse_bcfbaf(files)).count("Half-Life \\(days\\)") == 1
    assert text(RP.parse_kocwin(files)).count("Fragment Correction\\(s\\)") == 2


def test_sections_with_short_pieces_keep_their_context(spark):
    content = "KOWWIN Program" * 90 + "tail"
    rows = RP.sections(spark.createDataFrame([("f", content)], "file string, content string"), "KOWWIN").orderBy("record_index").collect()
    assert len(rows) == 90
    for k, r in enumerate(rows):
        assert r["context"] == ("KOWWIN Program" * k)[-1000:] and r["section"] == "KOWWIN Program" + ("tail" if k == 89 else "")


def test_ten_thousand_sections_in_one_file(spark):
    import time

    took = {}
    for n in (2_500, 10_000):
        df = spark.createDataFrame([("f", kow_report(n))], "file string, content string")
        start = time.perf_counter()
        got = RP.parse_kowwin(df).select("record_index", "chem_id", "log_kow").collect()
        took[n] = time.perf_counter() - start
        assert {(r["record_index"], r["chem_id"], r["log_kow"]) for r in got} == {(k + 1, f"name {k}", k + 0.25) for k in range(n)}
    assert took[10_000] < 10 * took[2_500] + 5  # four times the sections, far from sixteen times the time


def test_sections_read_over_many_ranges_equal_whole_files(spark, tmp_path):
    for k, n in enumerate((0, 1, 30)):
        (tmp_path / f"r{k}.txt").write_text("intro\n" + kow_report(n) + ("BIOWIN (v4) tail\n" if k else ""))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {x: spark.conf.get(x, None) for x in names}
    want = sorted(map(tuple, RP.sections(RD.read_reports(spark, str(tmp_path)), "KOWWIN").collect()))
    try:
        for x, v in zip(names, ("90", "0", "1")):
            spark.conf.set(x, v)
        got = RP.read_sections(spark, str(tmp_path), "KOWWIN")
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 30
        assert sorted(map(tuple, got.collect())) == want and len(want) == 31
        assert RP.parse_kowwin(got).where("chem_id = concat('name ', record_index - 1)").count() == 31
    finally:
        for x, v in before.items():
            spark.conf.unset(x) if v is None else spark.conf.set(x, v)


def test_sections_inside_a_range_are_not_shuffled(spark, tmp_path):
    """Files that are not cut into ranges give their sections without a shuffle of texts."""
    (tmp_path / "a.txt").write_text(kow_report(30))
    got = RP.read_sections(spark, str(tmp_path), "KOWWIN")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, RP.sections(RD.read_reports(spark, str(tmp_path)), "KOWWIN").collect()))


def test_report_files_take_little_room(spark, tmp_path):
    """The texts laid out by src_08_report_files are compressed: less than a fifth of their bytes."""
    rows = [(k, k % 50, f"name {k}", "Brand#1", 400.0) for k in range(1, 201)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int, p_name string, p_brand string, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    root, seen = pathlib.Path(stage_root(spark).removeprefix("file:")), set()
    seen = set(root.glob("reports-*"))
    got = {r["program"]: (r["n"], r["n_with_weight"]) for r in QUERIES["src_08_report_files"](spark, str(tmp_path)).collect()}
    assert got == {"KOWWIN": (240, 240), "BIOWIN": (200, 200), "BCFBAF": (200, 200), "KOCWIN": (200, 200)}
    (made,) = set(root.glob("reports-*")) - seen
    texts = report_files(spark, str(tmp_path)).agg(F.sum(F.octet_length("content"))).first()[0]
    assert sum(f.stat().st_size for f in made.glob("part-*")) < texts / 5


def test_arrays_are_trimmed_as_single_texts(spark):
    forms = [" a\t\n", "\u2003a ", "", "  ", "a \u0085", "a \u0085 ", None, "\u0085", " \u2028", "a\x0b\f\r\n", "a \u2029\n", "\u0085 a"]
    df = spark.createDataFrame([(forms,)], "v array<string>")
    got = df.select(X.strip_each(F.col("v")).alias("each"), F.transform("v", X.strip_all).alias("all")).first()
    assert got["each"] == got["all"]


def test_the_compound_table_is_worked_out_once_for_the_full_export(spark):
    """The export reads a written table: its plan holds no parser."""
    files = spark.createDataFrame([("a.txt", REPORT)], "file string, content string")
    table = D.compound_table(files)
    got = D.advanced_export(table)
    assert "SMILES\\s*:" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = table.select(*got.columns).collect()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and "BCFBAF_AD_Status" not in got.columns
