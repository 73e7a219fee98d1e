import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import quality as q

FOLDER = "/root/testdata/sf0.01"


def test_votes_give_back_planted_accuracies():
    rng = np.random.default_rng(1)
    n, good = 20000, 0.7
    y = rng.random(n) < good
    right = np.array([0.95, 0.9, 0.8, 0.75, 0.9])
    votes = np.where(rng.random((n, 5)) < right, y[:, None], ~y[:, None]).astype(int)
    votes[rng.random((n, 5)) < 0.3] = q.NONE
    keys, counts = np.unique([q.pattern(list(v)) for v in votes], return_counts=True)
    share, p, post = q.expectation_maximisation(keys, counts.astype(float), 5)
    assert share == pytest.approx(good, abs=0.03)
    assert p[:, 1] == pytest.approx(right, abs=0.04) and 1 - p[:, 0] == pytest.approx(right, abs=0.06)
    assert ((post > 0) & (post < 1)).all()


def test_defined_cases(spark):
    prose = "The cat sat on the mat and it was old. She ran to the big red barn by the sea. "
    rows = [(i, prose + f"We saw {i} of them there. " * (i % 3)) for i in range(30)] + [(100 + i, "BUY!!! NOW!!! " * (20 + i)) for i in range(10)]
    rows += [(900, None), (901, ""), (None, prose), (7, prose), (7, prose)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, quality string")
    got = q.classify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 for r in got)
    of = {r.doc_id: r for r in got}
    assert of[900].quality == of[901].quality == 0.0 and not of[900].kept
    assert all(of[i].kept for i in range(30)) and not any(of[100 + i].kept for i in range(10))
    assert of[None].quality == of[7].quality
    assert q.classify(docs.limit(0)).collect() == []


def test_expectation_maximisation_raises_the_likelihood_of_rows():
    """The fit over vote patterns against the likelihood summed row by row: no step of any accuracy or of the share makes it better."""
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.6
    votes = np.where(rng.random((3000, 4)) < [0.9, 0.8, 0.7, 0.85], y[:, None], ~y[:, None]).astype(int)
    votes[rng.random((3000, 4)) < 0.2] = q.NONE
    keys, counts = np.unique([q.pattern(list(v)) for v in votes], return_counts=True)
    share, p, post = q.expectation_maximisation(keys, counts.astype(float), 4)

    def likelihood(share, p):
        said = votes != q.NONE
        per = [np.where(said, np.where(votes == 1, p[:, c], 1 - p[:, c]), 1.0).prod(1) for c in (0, 1)]
        return np.log((1 - share) * per[0] + share * per[1]).sum()

    top = likelihood(share, p)
    for move in (-0.03, 0.03):
        assert likelihood(share + move, p) < top
        for j in range(4):
            for c in (0, 1):
                near = p.copy()
                near[j, c] += move
                assert likelihood(share, near) < top
    # posteriors by Bayes' rule, row by row
    of = dict(zip(keys, post))
    said = votes != q.NONE
    per = [np.where(said, np.where(votes == 1, p[:, c], 1 - p[:, c]), 1.0).prod(1) for c in (0, 1)]
    want = share * per[1] / ((1 - share) * per[0] + share * per[1])
    assert np.array([of[q.pattern(list(v))] for v in votes]) == pytest.approx(want, abs=0.02)


def test_a_hot_text_is_one_text_of_the_sample(spark):
    prose = "The cat sat on the mat and it was old. She ran to the big red barn by the sea. "
    rows = [prose + f"We saw {i} of them there on the {i} hill. " for i in range(400)] + [f"BUY!!! NOW!!! {i} " * (20 + i % 7) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    first = docs.orderBy(F.xxhash64("text", F.lit(2))).first().text
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, first) for i in range(300)], "doc_id long, text string"))
    got = {r.doc_id: r.kept for r in q.classify(docs, sample_rows=200).collect()}
    assert all(got[i] for i in range(400)) and not any(got[i] for i in range(400, 500))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat and it was old. " * 60_000), (2, "The cat sat on the mat and it was old. She ran home.")] * 20, "doc_id long, text string")
    assert {r.doc_id for r in q.classify(docs).collect()} == {1, 2}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_agrees_with_labels_it_never_saw(spark):
    got = q.op2_quality_classifier(spark, FOLDER).join(spark.read.parquet(FOLDER + "/labels.parquet").select("doc_id", F.col("quality").alias("y")), "doc_id")
    right, n = got.agg(F.avg((F.col("kept") == (F.col("y") == 1)).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.97
