"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton holds every run of words of every item. A document's words are streamed through it; after each word it
knows the longest run that ends there and occurs in some item, so no window of the corpus is ever hashed, joined or
shuffled: one pass over the text, nothing exchanged.

A document with a larger share of hit words is contaminated; others lose the spans (``decontaminate``). Very long texts are walked like others, word by word.

Defined cases: a null or wordless document has no words, no hits and stays; a null or wordless item has no window; items
with one id count once, items without an id hit but are not listed; an empty benchmark hits nothing. Columns of the
input other than the text are carried through unread; the added columns are named in ``ADDED``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import batches, query, read, utf8

WINDOW = 13
ITEM_WORDS = 2_000_000  # words of the test items that one automaton holds; larger benchmarks take several passes

# Word characters are 0-9, a-z and everything beyond ASCII; all other bytes part words.
_TABLE = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
ADDED = ("n_words", "hit_spans", "hit_items")


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """All runs of words of a set of items, with the items behind each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        split = [(i, [self.ids.setdefault(w, len(self.ids) + 1) for w in item_words(t)]) for i, t in items]
        split = [(i, ws) for i, ws in split if ws]
        for _, ws in split:
            self._add(ws)
        # A window (or a whole shorter item) is a path from the root; its state names the items that hold it.
        self.owners: dict[tuple[int, int], set[str]] = {}  # (state, length) -> items
        self.sizes: dict[int, list[int]] = {}  # state -> lengths of windows that the state stands for
        for item, ws in split:
            size = min(window, len(ws))
            for at in range(len(ws) - size + 1):
                s = 0
                for w in ws[at:at + size]:
                    s = self.next[s][w]
                self.owners.setdefault((s, size), set())
                if item is not None:
                    self.owners[s, size].add(item)
        for s, size in self.owners:
            self.sizes.setdefault(s, []).append(size)
        self.shortest = min((n for _, n in self.owners), default=0)
        # nearest state on the suffix path, the state itself included, that stands for a window
        order = np.argsort(self.len, kind="stable").tolist()
        self.near = [-1] * len(self.len)
        for s in order[1:]:
            self.near[s] = s if s in self.sizes else self.near[self.link[s]] if self.link[s] > 0 else -1

    def _add(self, ws: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in ws:
            q = nxt[last].get(w)
            if q is not None:  # the run is known from an earlier item: reuse its state, or split it
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges [start, end) of words inside occurring windows, disjoint and in order, and the items hit."""
        if self.shortest == 0 or len(ws) < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.ids.get, ws, _zeros()), np.int32, len(ws))
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        nxt, link, length, near = self.next, self.link, self.len, self.near
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):  # runs of words that items use at all
            if b - a < self.shortest:
                continue
            s = n = 0
            for at, w in enumerate(ids[a:b].tolist(), a):
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if w in nxt[s]:
                    s, n = nxt[s][w], n + 1
                t = near[s]
                longest = 0
                while t > 0:
                    for size in self.sizes[t]:
                        if size <= n:
                            longest = max(longest, size)
                            found |= self.owners[t, size]
                    t = near[link[t]] if link[t] > 0 else -1
                if longest:
                    start = at + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, found


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end:at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


def match_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                window: int = WINDOW, item_words_limit: int = ITEM_WORDS, cut_below: int | None = None) -> DataFrame:
    """``docs`` with n_words, hit_spans (word ranges inside occurring windows) and hit_items (sorted ids).

    With ``cut_below`` rows whose words are hit to less than that many percent lose the hit words and what stands between them from their text.

    Test items are a fixed set beside the corpus; they are packed into automata of at most ``item_words_limit`` words
    each (about 200 bytes a word in a task), one pass over the rows for each, and the hits are united. Existing columns of
    the added names are replaced.
    """
    rest = [c for c in docs.columns if c not in ADDED]
    parts: list[list[tuple[str | None, bytes | None]]] = [[]]
    size = 0
    for r in items.select(F.col(item_id).cast("string"), F.col(item_text).cast("binary")).toLocalIterator():
        n = len(item_words(r[1]))
        if not n:
            continue
        if size + n > item_words_limit and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((r[0], bytes(r[1])))
        size += n
    out = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumns({
        "n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<struct<start:int,end:int>>"),
        "hit_items": F.array().cast("array<string>")})
    for k, part in enumerate(parts):
        # Handed to tasks once per executor; built there into links and states.
        last = cut_below if k == len(parts) - 1 else None
        out = out.mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(part), text, window, last), out.schema)
    return out


def _matcher(part, text: str, window: int, cut_below: int | None):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = SuffixAutomaton(part.value, window)
        for b in batches(frames):
            n, spans, items, texts = [], [], [], []
            for t, old, ids in zip(utf8(b, text), b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist()):
                ws = item_words(t)
                got, found = auto.match(ws)
                n.append(len(ws))
                spans.append([{"start": x, "end": y} for x, y in
                              (_merge(got + [(s["start"], s["end"]) for s in old]) if old else got)])
                items.append(sorted(found.union(ids)))
                if cut_below is not None:
                    hit = sum(x["end"] - x["start"] for x in spans[-1])
                    texts.append(cut_spans(t, [(x["start"], x["end"]) for x in spans[-1]]) if hit and 100 * hit < cut_below * len(ws) else t)
            cols = {"n_words": pa.array(n, pa.int64()), "hit_spans": pa.array(spans, b.schema.field("hit_spans").type),
                    "hit_items": pa.array(items, b.schema.field("hit_items").type)}
            if cut_below is not None:
                cols[text] = pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions.unsafe(pa.string()))
            yield pa.RecordBatch.from_arrays([cols.get(f.name, b.column(k)) for k, f in enumerate(b.schema)], schema=b.schema)

    return run


def n_hit() -> Column:
    """Words inside occurring windows."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(percent: int = 5) -> Column:
    """True where at least ``percent`` of the words are hit, and one is."""
    return (n_hit() > 0) & (100 * n_hit() >= percent * F.col("n_words"))


def without_spans(matched: DataFrame, text: str = "text", least: int = WINDOW) -> DataFrame:
    """The matched rows with spans of ``least`` or more words cut out of the text."""
    @F.pandas_udf(T.StringType())
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None else cut_spans(t.encode(), [
            (x["start"], x["end"]) for x in s if x["end"] - x["start"] >= least]).decode())

    return matched.withColumn(text, F.when(F.size("hit_spans") == 0, F.col(text)).otherwise(cut(text, "hit_spans")))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 5, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their own columns; windows that they hold nevertheless are cut out of their texts."""
    own = {c: f"{c}_of_input" if c in ADDED else c for c in docs.columns}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    return match_items(renamed, items, window=window, cut_below=percent).where(~contaminated(percent)).select(*[F.col(f"`{n}`").alias(c) for c, n in own.items()])


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op10_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    m = match_items(docs, read(spark, folder, "benchmark"))
    return m.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same digest by comparing every window with every position; for tests."""
    out = []
    split = [(i, item_words(t.encode())) for i, t in items if t]
    for doc_id, t in docs:
        ws, hit, found = item_words((t or "").encode()), set(), set()
        for i, iw in split:
            size = min(window, len(iw))
            for g in {tuple(iw[k:k + size]) for k in range(len(iw) - size + 1)} if size else ():
                for k in range(len(ws) - size + 1):
                    if tuple(ws[k:k + size]) == g:
                        hit |= set(range(k, k + size))
                        found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(ws)))
    return out
