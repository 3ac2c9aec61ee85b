"""The registered queries: contract, and a sample of them against their oracle in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "reg_02_metrics_by_split", "flt_05_outliers_by_split", "sca_06_fill_mode", "sta_03_correlation_matrix", "win_02_forward_fill_by",
    "spl_04_endpoints", "jon_04_key_candidates", "reg_07_williams", "chm_11_batch_scoring", "agg_13_hoisted_prefix", "src_09_group_definitions",
    "clu_10_label_sample", "stream_linear_scores", "src_05_encoding_fallback",
]


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == want
