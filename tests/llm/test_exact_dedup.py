import pytest
from hypothesis import given, settings, strategies as st

from gleanworks.llm.exact_dedup import mark_duplicates

SCHEMA = "doc_id long, text string, kept string, _row long"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), i == best[t or ""]) for i, t in rows)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in mark_duplicates(docs, **how).collect())


ROWS = [(1, "ab" * 9), (2, "ab" * 9), (3, "ab" * 9 + "c"), (4, None), (5, ""), (6, "ab"), (7, "ab" * 8 + "ba"), (8, "é" * 40),
        (9, "é" * 40), (9, "é" * 40), (None, "ab"), (None, "alone"), (10, "x" * 5000), (11, "x" * 5000), (12, "x" * 4999 + "y"), (13, "abababab")]


@pytest.mark.parametrize("how", [{}, {"block": 2}, {"block": 2, "key_bits": 2}, {"block": 3, "key_bits": 1}])
def test_names_stand_for_contents(spark, how):
    assert run(spark, ROWS, **how) == brute(ROWS)


def test_empty_table(spark):
    assert run(spark, []) == []


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text("ab", max_size=9), min_size=1, max_size=30))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    assert run(spark, rows, block=2, key_bits=3) == brute(rows)
