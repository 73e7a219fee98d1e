import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleanworks.llm import token_alignment as ta

pytestmark = pytest.mark.skipif(not os.path.exists(f"{ta.TOKENIZERS}/{ta.B_FILE}"), reason="no vocabulary files")
FILES = (ta.TOKENIZERS, ta.A_FILE, ta.B_FILE)


def whole(tok, t):
    """Ids by both tokenizers over the whole text at once."""
    a, b = tok.a.encode(" " + t, add_special_tokens=False).ids, tok.b.encode(t)
    ok = all(b"".join(of[i] for i in ids) == b" " + t.encode() for of, ids in ((tok.bytes_a, a), (tok.bytes_b, b)))
    return (a, b) if ok else ([], [])


def brute(rows):
    """The contract token by token, all pairs of ranges compared."""
    tok, docs, links = ta._loaded(*FILES), [], Counter()
    for i, t in rows:
        a, b = whole(tok, t) if t else ([], [])
        spans = []
        for ids, of in ((a, tok.bytes_a), (b, tok.bytes_b)):
            ends = np.cumsum([0] + [len(of[k]) for k in ids]).tolist()
            spans.append(list(zip(ids, ends, ends[1:])))
        both = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        groups, start = [], 0
        for e in sorted(both):
            groups.append("|".join(",".join(str(k) for k, s, z in side if start <= s and z <= e) for side in spans))
            start = e
        pairs = [(x, y) for x, s, e in spans[0] for y, p, q in spans[1] if s < q and p < e]
        links.update(pairs)
        docs.append((i, len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (x, y), n in links.items():
        best[y] = max(best[y], n)
    return sorted(((str(i), a, b, g, len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), sha) for i, a, b, g, p, sha in docs))


def texts():
    rng = random.Random(4)
    stems = ["an", "thent", "Übung", "été", "3.14", "<|endoftext|>", "<s>", "naïve", "🙂", "snake_case", "don't", "\n", "\t", "  ", "日本語", "é", " ", "²", "ﬁ", "▁", "x" * 40]
    out = ["".join(rng.choice(stems) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return out + [" ", "a", " lead and trail ", "▁", "tab\there", "a​ b", "the of and " * 50, None, "", "same text", "same text"]


@pytest.mark.parametrize("common", [1e-6, 0.01, 1.0])
def test_query_equals_contract(spark, tmp_path, common, monkeypatch):
    rows = [*enumerate(texts()), (None, "null id"), (3, "again")]
    spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_a int").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ta.align, "__defaults__", ("text", FILES, common, None))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = ta.op12_token_alignment(spark, str(tmp_path))
    assert got.columns == names
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute(rows)


def test_sections_give_the_tokens_of_whole_texts():
    tok = ta._loaded(*FILES)
    given_texts = [t for t in texts() if t]
    ids_a, from_a, ids_b, from_b = tok.encode(given_texts)
    for k, t in enumerate(given_texts):
        assert (ids_a[from_a[k]:from_a[k + 1]].tolist(), ids_b[from_b[k]:from_b[k + 1]].tolist()) == whole(tok, t), t
    assert len(tok.sections("one two, three  four \n five")) == 3


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .,'\n\t1é²—…  ́<s>日"), max_size=25))
def test_sections_on_random_texts(t):
    tok = ta._loaded(*FILES)
    ids_a, _, ids_b, _ = tok.encode([t])
    assert (ids_a.tolist(), ids_b.tolist()) == (whole(tok, t) if t else ([], []))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1), st.lists(st.integers(0, 300), min_size=1))
def test_gallop_finds_the_first_end_not_below(long, targets):
    ends, at = np.array(sorted({*long, 301})), np.zeros(len(targets), np.int64)
    assert ta.gallop(np.array(targets), ends, at).tolist() == np.searchsorted(ends, targets).tolist()


def test_rows_keep_their_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("one two", "k", 1)], "text string, `odd name` string, n_best int")
    out = ta.align(docs)
    assert out.columns == ["text", "odd name", *ta.ADDED] and out.first().groups.count(";") == 1
    assert ta.align(docs.limit(0)).collect() == []


def test_very_long_text():
    tok = ta._loaded(*FILES)
    t = "antidisestablishment of the reeves " * 30_000
    al = ta.Aligned(tok, *tok.encode([t, "x"]))
    assert al.n_groups().tolist()[1] == 1 and np.bincount(al.text)[0] >= al.from_a[1]
