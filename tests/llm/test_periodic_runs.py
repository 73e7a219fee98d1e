import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleanworks.llm import periodic_runs as pr


def brute(ws, least=12):
    """All runs by the definition: maximal stretches of every period, those with a smaller period left out."""
    n, out = len(ws), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def runs_of(texts):
    number = {}
    first = np.cumsum([0, *map(len, texts)])
    words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    found = pr.find_runs(words, first)
    return [[(int(s - first[k]), int(e - s), int(q)) for s, e, q in found if first[k] <= s < first[k + 1]] for k in range(len(texts))]


def test_transform_gives_the_convolution():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9000, (3, 16)), rng.integers(0, 9000, (3, 16))
    a[:, 8:] = b[:, 8:] = 0
    got = pr.restore(pr.transform(a) * pr.transform(b) % np.uint64(pr.PRIME))
    assert got.astype(int).tolist() == [np.convolve(x, y)[:16].tolist() for x, y in zip(a[:, :9], b[:, :8])]


def test_digits_keep_sums_below_the_modulus():
    words = np.arange(200_000)
    for size in (2, 64, 1 << 14, 1 << 20):
        planes = pr.digits(words, size)
        assert sum(int(p.max()) ** 2 for p in planes) * size < pr.PRIME
        assert len(set(zip(*[p.tolist() for p in planes]))) == len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=6))
def test_equals_definition_on_few_words(texts):
    assert runs_of(texts) == [brute(t) for t in texts]


def test_equals_definition_on_planted_runs():
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        t = []
        while len(t) < rng.choice([5, 60, 300, 700]):
            unit = [rng.choice("abcdefghijklmnop" if rng.random() < 0.7 else "ab") for _ in range(rng.choice([1, 2, 3, 6, 7, 13, 14, 15, 40, 90]))]
            t += (unit * 9)[:rng.randint(1, 4 * len(unit))]
        texts.append(t)
    texts += [["a"] * 500, list("ab" * 200), (["a"] * 100 + ["b"]) * 6, []]
    got = runs_of(texts)
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 100


def contract(doc_id, text):
    ws = (text or "").encode().split()
    n, h = len(ws), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute(ws)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (str(doc_id), len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_query_equals_contract(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["an", "Be", "dé", " x", "in\x0b", "of"]) for _ in range(rng.choice([0, 3, 11, 30, 200])))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "a " * 30), (7, "x y " * 20), (7, "x y " * 20), (502, " \n\t"), (503, "ab " * 3000 + "end"),
             *[(i, None if i % 2 else "w v u " * 9) for i in range(600, 640)]]
    spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple([str(r[0]), *r[1:]]) for r in pr.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract(i, t) for i, t in rows), key=str)


def test_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([("a b " * 8, 1, "k"), (None, 2, "k")], "text string, `runs` int, `odd name` string")
    got = pr.mark_runs(docs).collect()
    assert [f.name for f in pr.mark_runs(docs).schema] == ["text", "odd name", "n_words", "runs", "collapsed"]
    assert [tuple(r.runs[0]) for r in got if r.runs] == [(0, 16, 2)] and {r.collapsed for r in got} == {"a b", ""}
    assert pr.mark_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [200_000])
def test_very_long_text(n):
    rng = random.Random(1)
    unit = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n // 4)]
    got = runs_of([unit * 2 + ["!"] + unit[:100] * 30])[0]
    assert (0, n // 2, n // 4) in got and (n // 2 + 1, 3000, 100) in got
