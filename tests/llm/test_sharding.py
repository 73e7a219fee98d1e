from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import sharding as sh


@pytest.mark.parametrize("pop,good,draws", [(50, 20, 10), (1000, 25, 900), (100000, 60000, 70000), (30, 30, 7), (9, 0, 4), (10, 4, 10)])
def test_draws_follow_the_law(spark, pop, good, draws):
    n = 6000
    x = np.array([r[0] for r in spark.range(n).select(sh.hypergeometric(F.lit(pop), F.lit(good), F.lit(draws), F.lit(1), F.col("id"))).collect()])
    assert x.min() >= max(0, draws + good - pop) and x.max() <= min(good, draws)
    p = good / pop
    var = draws * p * (1 - p) * (pop - draws) / (pop - 1)
    assert abs(x.mean() - draws * p) <= 5 * (var / n) ** 0.5 and abs(x.var() - var) <= 0.1 * var


def test_matrix_has_its_margins(spark):
    counts = [(0, 7), (1, 0), (2, 100), (5, 31), (900, 62)]
    sizes = [67, 67, 66, 0]
    m = {r.part: list(r.sent) for r in sh.communication_matrix(spark.createDataFrame(counts, "part long, n long"), F.array(*map(F.lit, sizes)), group=2).collect()}
    assert {k: sum(v) for k, v in m.items()} == dict(counts)
    assert [sum(v[s] for v in m.values()) for s in range(4)] == sizes


def shards_of(spark, rows, parts, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, _rank int").repartition(parts)
    return sh.shard(docs, **how)


def test_sizes_and_slots(spark):
    rows = [(i % 90 if i % 7 else None, None if i % 11 == 0 else "t" * (i % 5), "x", i) for i in range(203)]
    for parts, shards, chunk in ((1, 4, 20_000), (5, 7, 3)):
        out = shards_of(spark, rows, parts, shards=shards, chunk=chunk)
        assert out.columns == ["doc_id", "text", "_rank", "shard", "slot"]
        got = out.collect()
        assert Counter((r.doc_id, r.text, r._rank) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    few = shards_of(spark, rows[:3], 2, shards=5).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert shards_of(spark, [], 1, shards=3).collect() == []


def test_shuffle_is_uniform(spark):
    """Over seeds, any row is as likely in any shard, and neighbours are no more together than others."""
    rows = [(i, "", "", i) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, _rank int").coalesce(1)
    first, together, n = Counter(), 0, 10
    for seed in range(n):
        at = {r.doc_id: r.shard for r in sh.shard(docs, shards=3, seed=seed).collect()}
        first.update(at.values())
        together += sum(at[i] == at[i + 1] for i in range(0, 24, 2))
    assert set(first.values()) == {8 * n}
    assert abs(together / (12 * n) - 7 / 23) < 0.16
