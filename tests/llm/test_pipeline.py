import random

import corpus_pipeline
import pytest
from gleanworks.llm import near_dedup


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    item = prose(20)
    docs = [(i, prose(60)) for i in range(80)]
    docs += [(100 + i, docs[i][1] + (" idiot trash" if i % 2 else " scum")) for i in range(24)]  # toxic, each with a clean near copy
    docs += [(200 + i, docs[30][1]) for i in range(6)] + [(300, docs[31][1] + " tail"), (400, prose(30) + " " + item + " " + prose(30)), (401, item)]
    docs += [(500, None), (501, "")]
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in docs if i % 3]
    write(spark, str(tmp_path), [(i, t, "en", f"src{i % 20}", len(t or "")) for i, t in docs], labels, [(1, item), (2, None)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    clean = [i for i, _ in docs if i < 100 or i >= 500]
    assert set(ids) <= set(clean) and len(set(ids)) == len(ids) >= 0.6 * len(clean)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("empty", [True, False])
def test_each_stage_keeps_columns(spark, tmp_path, empty):
    docs = [] if empty else [(1, "a b", "en", "src0", 3), (1, "a b", "en", "src0", 3), (None, None, None, None, None), (2, "", None, "src1", 0)]
    write(spark, str(tmp_path), docs, [], [])
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        frame = spark.createDataFrame(out.collect(), out.schema)
        assert frame.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert not empty or frame.count() == 0


def test_stages_send_small_batches_to_python(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5_000)], "doc_id long, text string").coalesce(1)
    spark.createDataFrame([("i", "some words of an item")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        rows = docs.mapInArrow(lambda bs: (b.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
        assert rows.agg({"n": "max"}).first()[0] == corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_word_hashes_stay_bounded():
    memo = near_dedup._WordHashes()
    for i in range(2 * near_dedup.WORDS_HELD + 5):
        memo[b"%d" % i]
    assert len(memo) <= near_dedup.WORDS_HELD < 500_000
