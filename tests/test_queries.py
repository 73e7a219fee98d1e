"""A cross-section of registered queries against their SQL twins on the smallest tables; tools/check_sql.py runs all of them."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("rule_filter", "text_fingerprints", "dedup_exact", "split_by_group", "evaluate_rules", "trace_summary", "repeat_actions", "return_eligibility", "topk_similar")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(str(tuple(r[cols.index(c)] for c in sorted(cols))) for r in rel.fetchall())
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(str(tuple(r[c] for c in sorted(cols))) for r in df.collect()) == want


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", ("visual_tokens", "visual_token_stats"))
def test_image_sizes_of_pages(spark, name):
    test_query_equals_sql(spark, name)
