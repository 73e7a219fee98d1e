import hashlib
from collections import defaultdict
from fractions import Fraction

from gleanworks.llm import mixing as mx


def water(children, budget):
    """name -> (weight, room): repeat: those below their share leave with their room."""
    out, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, r) in open_.items() if r <= Fraction(budget * w, total)}
        if not full:
            return {**out, **{k: budget * w // total for k, (w, _) in open_.items()}}
        for k in full:
            out[k] = open_.pop(k)[1]
            budget -= out[k]
    return out


def brute(rows, share, epochs, seed):
    leaf = defaultdict(list)
    for i, t, lang, src in rows:
        d = next((d for d, names in mx.DOMAINS.items() if src in names), "other")
        leaf[d, lang, src].append((str(i) if i is not None else hashlib.md5(t.encode()).hexdigest() if t is not None else "", len((t or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    room = {k: n * epochs for k, n in tokens.items()}
    budget = {(): int(float(sum(tokens.values())) * share)}
    for level, table in enumerate((mx.DOMAIN_WEIGHTS, mx.LANGUAGE_WEIGHTS, mx.SOURCE_WEIGHTS), 1):
        for parent in {k[:level - 1] for k in leaf}:
            kids = {k[:level] for k in leaf if k[:level - 1] == parent}
            budget |= water({k: (table.get(k[-1], 1), sum(r for x, r in room.items() if x[:level] == k)) for k in kids}, budget[parent])
    out = defaultdict(int)
    for k, docs in leaf.items():
        q, rest = divmod(budget[k], tokens[k]) if tokens[k] else (0, 0)
        keyed = sorted((hashlib.md5(f"{seed}|{q}|{name}".encode()).hexdigest(), n, name) for name, n in docs)
        for key, n, name in keyed:
            copies = q + (rest > 0 and sum(m for x, m, _ in keyed if x <= key) <= rest)
            out[k, name, copies] += 1
    return budget, out


ROWS = [(i, "w " * (i * 7 % 23), ("en", "de", "fr", None)[i % 4], f"src{i % 19}" if i % 13 else None) for i in range(300)]
ROWS += [(900, None, "en", "src0"), (901, "", "en", "src0"), (None, "a b c", "en", "src1"), (None, None, "en", "src1"), (5, "w w", "de", "src5"), (5, "w w", "de", "src5"), (902, " \t ", "xx", "lonely")]


def test_budgets_and_prefixes(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, source string, copies string")
    for share, epochs in ((0.9, 1), (0.7, 3), (2.5, 3)):
        budget, want = brute(ROWS, share, epochs, mx.SEED)
        got, given = defaultdict(int), {}
        for r in mx.mix(docs, share, epochs).collect():
            name = str(r.doc_id) if r.doc_id is not None else hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else ""
            got[(r.domain, r.language, r.source_leaf), name, r.copies] += 1
            given[r.domain, r.language, r.source_leaf] = r.leaf_budget
        assert given == {k: v for k, v in budget.items() if len(k) == 3}
        assert got == want


def test_take(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    once = mx.take(docs, 0.5, 1)
    assert once.columns == docs.columns and 0 < once.count() < len(ROWS)
    twice = mx.take(docs, 1.5, 2)
    n = mx.mix(docs, 1.5, 2).agg({"copies": "sum"}).first()[0]
    assert twice.count() == n > len(ROWS)
    assert mx.take(docs.limit(0), 0.5, 2).collect() == []
