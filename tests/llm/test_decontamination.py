import random

from gleanworks.llm import decontamination as d


def digest(spark, docs, items, **how):
    a = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hit_items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    m = d.match_items(a, b, **how)
    rows = m.select("doc_id", "n_words", d.n_hit().alias("h"), "hit_items", d.contaminated().alias("c")).collect()
    return sorted(((r.doc_id, r.n_words, r.h, len(r.hit_items), r.c) for r in rows), key=str)


def want(docs, items, window=d.WINDOW):
    return sorted(((i, n, h, k, c) for i, n, h, k, _, c in d.brute_force(docs, items, window)), key=str)


def test_random_runs_equal_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, some(rng.randint(1, 9))) for i in range(12)] + [(20, None), (21, ""), (22, "-- !"), (3, "c c c a")]
    docs = [(i, some(rng.randint(0, 40)).replace("a", rng.choice(["a", "A", "a,"]))) for i in range(150)] + [(900, None), (901, ""), (None, some(30)), (5, some(9)), (5, some(9))]
    for window in (3, 5, 13):
        assert digest(spark, docs, items, window=window) == want(docs, items, window)
    assert digest(spark, docs, items, window=4, item_words_limit=10) == want(docs, items, 4)  # several automata


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "x " + item.upper() + " y"), (2, " ".join(item.split()[:12])), (3, "é " * 400 + item), (4, None)]
    assert digest(spark, docs, [(7, item)]) == want(docs, [(7, item)])
    assert digest(spark, docs, []) == want(docs, [])
    assert digest(spark, [], [(7, item)]) == []


def test_contaminated_rows_go_and_spans_are_cut(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a {item} b", "own"), (2, "q " * 500 + item + " end", "own"), (3, None, "own")], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns and {(r.doc_id, r.n_words) for r in kept.collect()} == {(2, "own"), (3, "own")}
    cut = {r.doc_id: r.text for r in d.without_spans(d.match_items(docs, items)).collect()}
    assert cut[1].split() == ["a", "b"] and cut[2].endswith("end") and "w3" not in cut[2] and cut[3] is None


def test_rows_that_stay_lose_windows_over_several_automata(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(15)) for c in "vw")
    docs = spark.createDataFrame([(1, "q " * 600 + one.upper() + " mid, " + two + " end", 3, "own"), (2, "plain é text", 4, "own"), (3, two, 5, None)], "doc_id long, text string, shard int, hit_items string")
    items = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    renamed = docs.drop("hit_items")
    for limit in (10, 1000):
        m = d.match_items(renamed, items, item_words_limit=limit, cut_below=5)
        got = {r.doc_id: r.text for r in m.collect()}
        assert got[1].split() == ["q"] * 600 + ["mid,", "end"] and got[2] == "plain é text" and got[3] == two
    kept = {r.doc_id: tuple(r)[2:] for r in d.decontaminate(docs, items).collect()}
    assert kept == {1: (3, "own"), 2: (4, "own")}


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, "q " * 500_000 + item)], "doc_id long, text string")
    r = d.match_items(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert r.n_words == 500_015 and [tuple(s) for s in r.hit_spans] == [(500_000, 500_015)]
