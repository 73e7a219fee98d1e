import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.operators import retrieval, vectors


def table(spark, x, ids="id", cats=None):
    return spark.createDataFrame([(i, None if cats is None else cats[i], v.tolist()) for i, v in enumerate(x)], f"{ids} long, cat string, vec array<double>")


def brute(q, x, k, qc=None, xc=None):
    s = np.round(vectors.unit(q) @ vectors.unit(x).T, 12)
    out = []
    for i, row in enumerate(s):
        ok = [j for j in range(len(x)) if qc is None or qc[i] == xc[j]]
        out += [(i, j) for j in sorted(ok, key=lambda j: (-row[j], j))[:k]]
    return sorted(out)


def clustered(rng, n, d=16, k=30):
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] + 0.05 * rng.normal(size=(n, d))


def pairs(df):
    return sorted((r.qid, r.id) for r in df.select("qid", "id").collect())


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = vectors.unit(rng.normal(size=(400, 8))), vectors.unit(rng.normal(size=(50, 8)))
    x[:5], q[0] = 0, 0
    centres = vectors.k_means(x, 12)
    cell = np.argmin(((x[:, None] - centres) ** 2).sum(2), 1)
    far = np.linalg.norm(x - centres[cell], axis=1)
    for c in range(len(centres)):
        mine = cell == c
        b = vectors.upper_bounds(q, centres, np.array([c]), far[mine].min()[None], far[mine].max()[None], (np.linalg.norm(x[mine], axis=1) > 0.5).all()[None])
        assert (b[:, 0] >= (q @ x[mine].T).max(1) - 1e-9).all()


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_join_equals_brute_force_and_skips_far_cells(spark, block):
    rng = np.random.default_rng(2)
    x = clustered(rng, 900)
    x[:300] = x[0]  # a hot group of copies
    x[5], x[7] = 0, np.nan_to_num(x[7])
    seen = []
    got = vectors.nearest(table(spark, x[:200], "qid"), table(spark, x), 5, lists=30, block=block, seen=seen)
    assert pairs(got) == brute(x[:200], x, 5)
    tight = clustered(rng, 900)
    seen = []
    vectors.nearest(table(spark, tight, "qid"), table(spark, tight), 5, lists=30, block=min(block, 64), seen=seen).count()
    assert sum(seen) < 0.35 * 900 * 900, seen  # far pairs of query and block are never scored


def test_categories(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 300)
    cats = [None if i % 7 == 0 else "hot" if i % 3 else f"c{i % 5}" for i in range(300)]
    got = vectors.nearest(table(spark, x, "qid", cats), table(spark, x, "id", cats), 4)
    assert pairs(got) == brute(x, x, 4, cats, cats)
    old, vectors.HELD_RINGS = vectors.HELD_RINGS, 3
    try:
        assert pairs(vectors.nearest(table(spark, x, "qid", cats), table(spark, x, "id", cats), 4)) == brute(x, x, 4, cats, cats)
    finally:
        vectors.HELD_RINGS = old


@pytest.mark.parametrize("kind", ["clustered", "random", "one hot cell"])
def test_recall_of_the_approximate_search(spark, kind):
    rng = np.random.default_rng(4)
    x = clustered(rng, 3000) if kind == "clustered" else rng.normal(size=(3000, 64))
    if kind == "one hot cell":
        x[:2500] = x[0] + 0.1 * rng.normal(size=(2500, 64))
    q = x[::100]
    index, queries = table(spark, x), table(spark, q, "qid")
    got = retrieval.ann_topk(queries, index, 10)
    n = [r.n for r in got.groupBy("qid").agg(F.count("*").alias("n")).collect()]
    assert n == [10] * len(q)
    assert len(set(pairs(got)) & set(brute(q, x, 10))) >= 0.9 * 10 * len(q)


def test_few_rows(spark):
    x = np.random.default_rng(5).normal(size=(3, 5))
    assert pairs(retrieval.ann_topk(table(spark, x, "qid"), table(spark, x), 10)) == brute(x, x, 10)
    assert vectors.nearest(table(spark, x, "qid"), table(spark, x).limit(0), 3).count() == 0


def test_scan_gives_k_rows_a_query_and_task(spark):
    """Batches, blocks and groups of copies change neither the rows nor how many of them leave a task."""
    rng = np.random.default_rng(7)
    x = clustered(rng, 900)
    x[200:600], x[5] = x[0], 0  # copies in many batches, a vector of zeros
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for block in (7, 512):
            assert pairs(retrieval.topk_similar(table(spark, x[:100], "qid"), table(spark, x), 5, block=block)) == brute(x[:100], x, 5)
            assert pairs(retrieval.topk_similar(table(spark, x[:100], "qid"), table(spark, x), 5, held=10)) == brute(x[:100], x, 5)  # by cells
        scores = np.round(vectors.unit(x[:100]) @ vectors.unit(x).T, 12)
        others = [(i, j) for i in range(100) for j in sorted(set(range(900)) - {i}, key=lambda j: (-scores[i, j], j))[:5]]
        assert pairs(retrieval.topk_similar(table(spark, x[:100], "qid"), table(spark, x), 5, exclude_self=True)) == sorted(others)
        best = vectors.Best(np.arange(100), vectors.unit(x[:100]), 5)
        for at in range(0, 900, 50):
            best.add(np.arange(at, at + 50), vectors.unit(x[at:at + 50]))
            assert len(best.rows()) <= 500
        assert sorted(zip(best.rows()["qid"], best.rows()["id"])) == brute(x[:100], x, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_category_meets_nothing(spark):
    x = np.eye(3)
    t = lambda ids: table(spark, x, ids, [None, "a", None]).withColumnRenamed("cat", "category")
    for held in (0, 1000):
        assert pairs(retrieval.topk_similar(t("qid"), t("id"), 2, category=True, held=held)) == [(1, 1)]


def test_memory_does_not_grow_with_cells():
    """Rows meet thousands of centres, queries thousands of rings, in matrices of a bounded size."""
    import tracemalloc
    from types import SimpleNamespace as Held

    import pandas as pd
    rng = np.random.default_rng(8)
    x, centres = rng.normal(size=(10_000, 16)), rng.normal(size=(4096, 16))
    rings = 20_000
    held = (rng.integers(0, 4096, rings), np.arange(rings) % 8, np.zeros(rings), np.ones(rings), np.ones(rings, bool), np.full(rings, 10))
    run, _ = vectors._planner(Held(value=centres), Held(value={0: held}), 0, 100, "int")
    asked = pd.DataFrame({"qid": np.arange(600), "cat": 0, "vec": list(vectors.unit(x[:600])), "bar": np.nan})
    tracemalloc.start()
    try:
        cell = vectors._nearest(x, centres)
        frames = list(run(iter([asked])))
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
    assert (cell[:50] == np.argmin(((x[:50, None] - centres) ** 2).sum(2), 1)).all() and len(vectors._nearest(x[:0], centres)) == 0
    assert sum(len(f) for f in frames) == 600 * 10  # the ten best rings of each query hold its first hundred rows


def test_searches_take_every_row_as_query(spark):
    """F6 to F10: the queries were every hundredth row."""
    import __spark_entry__ as entry

    folder = entry.SMOKE_DIR
    rows = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    for name in ("topk_similar", "topk_by_category", "topk_blocked", "hybrid_search", "rerank"):
        assert "% 100" not in entry.oracle_sql()[name]
        assert {r.qid for r in entry.queries()[name](spark, folder).select("qid").distinct().collect()} == rows


def test_product_of_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    x = clustered(rng, 700)
    x[100:300], x[3] = x[0], 0
    cats = ["ab"[i % 2] for i in range(700)]
    got = {}
    for size, held in ((16, 30_000), (64, 50_000), (4096, 1 << 30)):  # shares of the index do not change the rows
        hits = vectors.all_scores(table(spark, x, "qid", cats), table(spark, x, "id", cats), 4, query_rows=size, rows=size, held=held)
        got[size] = pairs(vectors.top_per_group(hits, ["qid"], [F.col("score").desc(), F.col("id")], 4, "rank"))
    assert got[16] == got[64] == got[4096] == brute(x, x, 4, cats, cats)
