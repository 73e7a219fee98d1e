import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import toxicity as tx

FOLDER = "/root/testdata/sf0.01"


def table(spark, n=400):
    rng = random.Random(8)
    calm = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(calm) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            ws.insert(rng.randint(0, 30), rng.choice(["idiot,", "Trash", "pathetic."]))
        docs.append((i, " ".join(ws), i, "x"))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return docs, labels


def test_chain_on_words(spark):
    docs, labels = table(spark)
    docs += [(None, "idiot trash", 1, "x"), (900, None, 1, "x"), (901, "", 1, "x"), (5, docs[5][1], 5, "x")]
    labels += [(None, 1), (3, None), (12345, 1), (0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int, words string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tx.score(d, tx.train(d, lab))
    assert got.columns == ["doc_id", "text", "words", *tx.RESULT]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i].toxic == (i % 5 == 0) for i in range(400))
    assert rows[None].toxic and not rows[900].toxic and rows[900].p_toxic == rows[901].p_toxic
    kept = tx.drop_toxic(d, lab)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(400) if i % 5] + [900, 901])
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.drop_toxic(d, nothing).count() == len(docs)
    assert tx.drop_toxic(d.limit(0), lab).count() == 0


def test_fit_is_the_ridge_optimum():
    """Against plain gradient steps on the dense matrix."""
    rng = np.random.default_rng(3)
    x, dense = (rng.random((300, 40)) < 0.1).astype(float), rng.random((300, 2))
    y = (x[:, 0] + x[:, 1] + dense[:, 0] + 0.3 * rng.normal(size=300) > 0.8).astype(float)
    w, b = tx.fit_logistic(tx.Rows(*np.nonzero(x), 40, dense), y)
    wide = np.hstack([x, dense, np.ones((300, 1))])
    theta, penalty = np.zeros(43), np.append(np.full(42, tx.RIDGE), 1e-6)
    for _ in range(60_000):
        theta -= 0.01 * (wide.T @ (1 / (1 + np.exp(-wide @ theta)) - y) + penalty * theta)
    assert np.append(w, b) == pytest.approx(theta, abs=1e-4)


def test_all_significant_words_enter(spark):
    rng = random.Random(1)
    docs = [(i, " ".join([rng.choice(["calm", "plain"]), f"id{i}", *([f"slur{rng.randint(0, 599)}"] * (i % 3 == 0)), "x" * 2000 if i % 50 == 0 else ""])) for i in range(24_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(24_000)]
    chain = tx.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_rows=24_000)
    assert sum(w.startswith(b"slur") and not w.endswith(b" ") for w in chain.words) > 500
    at = {w: i for i, w in enumerate(chain.words)}
    p = chain.predict([[at[w] for w in sorted(at.keys() & tx.features(t))] for t in [b"calm idx " + w for w in chain.words if w.startswith(b"slur") and w[-1:] != b" "] + [b"calm plain"]])
    assert (p[:-1, -1] > 0.5).mean() > 0.99 and p[-1, -1] < 0.5


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 3)).astype(float)
    y = np.stack([x[:, 0], np.maximum(x[:, 0], x[:, 1])], axis=1)
    flip = rng.random(600) < 0.05
    y[flip, 0] = 1 - y[flip, 0]
    c = tx.fit_chain([b"a", b"b", b"c"], *np.nonzero(x), y, np.arange(600) % 5)
    assert c.earlier[1, 0] != 0 and c.earlier[0].sum() == 0
    p = c.predict([[], [0], [1], [0, 1, 2]])
    assert (p[:, 1] > 0.5).tolist() == [False, True, True, True] and (p[:, 0] > 0.5).tolist() == [False, True, False, True]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    got = tx.score(docs, tx.train(docs, labels.where(~held))).join(labels.where(held).select("doc_id", F.col("toxic").alias("y")), "doc_id")
    n = {(r.y, r.toxic): r["count"] for r in got.groupBy("y", "toxic").count().collect()}
    assert n.get((0, True), 0) <= 2 and n.get((1, True), 0) >= n.get((1, False), 0)
