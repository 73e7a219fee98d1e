import random

from gleanworks.llm.near_dedup import keep_one, near_duplicates


def sets(t):
    w = (t or "").translate({**{c: c + 32 for c in range(65, 91)}}).split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    label = {i: i for i in s}
    link = {i: [j for j in s if i != j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])] for i in s}
    for i in sorted(s):
        todo = [i]
        while todo:
            for j in link[todo.pop()]:
                if label[j] > label[i]:
                    label[j] = label[i]
                    todo.append(j)
    return sorted((i, len(s[i]), label[i], label[i] == i) for i in s)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    return sorted((tuple(r) for r in near_duplicates(docs, **how).collect()), key=str)


def family(rng, base, copies, edits):
    out = [base]
    for _ in range(copies):
        w = base.split()
        for at in rng.sample(range(len(w)), rng.randint(0, edits)):
            w[at] = f"q{rng.randint(0, 10**9)}"
        out.append(" ".join(w))
    return out


def some(rng, n):
    return " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [some(rng, rng.choice([1, 3, 4, 5, 6, 40, 150])) for _ in range(60)]
    passage = some(rng, 60)  # shared by many otherwise different texts
    texts += [some(rng, 50) + " " + passage + " " + some(rng, 40) for _ in range(40)]
    for edits in (1, 2, 6):
        texts += family(rng, some(rng, 150), 40, edits)
    chain = some(rng, 200).split()
    for k in range(25):  # each is near the one before it only
        chain[k * 7] = f"c{k}"
        texts.append(" ".join(chain))
    texts += ["", "  \t ", texts[70].upper(), texts[70], "a b", "A b"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    want = sorted(brute(rows), key=str)
    assert run(spark, rows) == want
    assert run(spark, rows, star_rounds=0) == want  # pair by pair from the start


def test_defined_cases(spark):
    base = some(random.Random(1), 100)
    rows = [(1, None), (2, base), (3, base), (3, base), (None, base), (4, ""), (5, "solo")]
    assert run(spark, rows) == sorted([(1, 0, 1, True), (2, 96, 2, True), (3, 96, 2, False), (3, 96, 2, False), (None, 96, None, True), (4, 0, 4, True), (5, 1, 5, True)], key=str)
    assert run(spark, []) == []
    docs = spark.createDataFrame([(*r, True, 1, 2) for r in rows], "doc_id long, text string, kept boolean, id int, row int")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "None"]


def test_repeated_rows_lose_no_link(spark):
    rng = random.Random(9)
    texts = [some(rng, 80) for _ in range(6)]
    for edits in (1, 2):
        texts += family(rng, some(rng, 150), 8, edits)
    rows = list(enumerate(texts, 1))
    label = {r[0]: r for r in brute(rows)}
    rows = rows * 3 + rows[:9]
    want = sorted((label[i] for i, _ in rows), key=str)
    assert run(spark, rows) == want
    assert run(spark, rows, star_rounds=0) == want
