"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote patterns
(at most 3 ** labellers of them, counted over all rows) estimates each labeller's accuracy and the share of good texts
without any true label. Posterior probabilities are the soft targets of a linear scorer over hashed features
of a text (words, word shapes, repeats), fitted on a bounded sample of rows (``SAMPLE_ROWS``, those with the smallest seeded
hash of the text). Its score judges every row, those on which no labeller votes included.

Defined cases: a null text counts as empty; a text without words is bad (score 0); equal texts get equal scores; doc_id is
only carried, nulls and repeats included. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import batches, query, read, utf8

BUCKETS, SAMPLE_ROWS, STEPS, RATE, DECAY = 1 << 14, 6_000, 400, 2.0, 1e-5
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("capitals", "marks", "stutter", "same_lines", "variety", "sentences", "word_length", "bars", "small_words")
_MARKS = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]")
# letters, capitals and digits of a word become x, X and 0; letters beyond ASCII count as small
_SHAPE = bytes(120 if 97 <= c <= 122 or c >= 0x80 else 88 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+")


def _vote(value: float, good: float, bad: float) -> int:
    """good below the first bound, bad above the second, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def votes(text: bytes, ws: list[bytes]) -> list[int]:
    """One vote per labeller; ``ws`` are the words of the text, at least one."""
    n = len(ws)
    lines = [x for x in text.split(b"\n") if x.strip()]
    capital = sum(w.isupper() for w in ws) / n
    marks = len(_MARKS.findall(text)) / n
    stutter = sum(a == b for a, b in zip(ws, ws[1:])) / n
    same = 1 - len(set(lines)) / max(1, len(lines))
    variety = len(set(ws)) / min(n, 400 + n ** 0.75)
    stops = sum(w[-1:] in b".!?" for w in ws)
    length = sum(map(len, ws)) / n
    small = sum(len(w) <= 3 and w.isalpha() for w in ws) / n
    bars = sum(w in (b"|", b"-", b"*", b"=") for w in ws) / n
    return [
        _vote(capital, 0.1, 0.5), _vote(marks, 0.02, 0.2), _vote(stutter, 0.02, 0.1), _vote(same, 0.05, 0.4) if len(lines) > 1 else NONE,
        _vote(-variety, -0.5, -0.25) if n >= 20 else NONE, _vote(abs(n / (stops + 0.5) - 14), 12, 60) if n >= 20 else NONE,
        _vote(abs(length - 6), 3, 6), _vote(bars, 0.01, 0.15), _vote(-small, -0.15, -0.04) if n >= 20 else NONE]


def pattern(vote: list[int]) -> int:
    return int(sum(v * 3 ** k for k, v in enumerate(vote)))


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, labellers: int, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, P(good vote | class) as labellers x 2, posterior of each pattern) from pattern counts.

    A labeller that does not vote says nothing about the class.
    """
    v = np.stack([patterns // 3 ** k % 3 for k in range(labellers)], axis=1)
    good, bad = (v == GOOD).astype(float), (v == BAD).astype(float)
    post = np.where(bad.any(1), 0.1, 0.9)  # labellers look for defects: at first one bad vote makes a bad text
    share, p = 0.5, np.full((labellers, 2), 0.5)
    for _ in range(steps):
        w = np.stack([n * (1 - post), n * post])
        share = (w[1].sum() + 1) / (n.sum() + 2)
        g, b = (w @ good).T + 0.5, (w @ bad).T + 0.5
        p = g / (g + b)
        odds = good @ np.log(p[:, 1] / p[:, 0]) + bad @ np.log((1 - p[:, 1]) / (1 - p[:, 0])) + np.log(share / (1 - share))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        moved = np.abs(fresh - post).max(initial=0)
        post = fresh
        if moved < 1e-9:
            break
    return share, p, post


class _Features(dict):
    """Hashed features of a word, computed once per word and task."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) > 300_000:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        tail = re.sub(rb"[0-9A-Za-z\x80-\xff]", b"", word)[-3:]
        low = word.lower()
        f = self[word] = (zlib.crc32(b"w" + low) % (BUCKETS - 3) if len(low) <= 5 else -1,  # long words tell texts apart, not qualities
                          zlib.crc32(b"s" + shape) % (BUCKETS - 3), zlib.crc32(b"t" + tail) % (BUCKETS - 3))
        return f


def features(text: bytes, ws: list[bytes], memo: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their shares of the words; the last three stand for shortness, repeated words and repeated lines."""
    n = len(ws)
    at = np.array(list(map(memo.__getitem__, ws)), np.int64).ravel()
    x = np.bincount(at[at >= 0], minlength=BUCKETS).astype(np.float64) / (n + 20)  # short texts lean on the intercept
    lines = [y for y in text.split(b"\n") if y.strip()]
    x[BUCKETS - 2] = 4 * sum(a == b for a, b in zip(ws, ws[1:])) / (n + 20)
    x[BUCKETS - 1] = 4 * (1 - len(set(lines)) / max(1, len(lines)))
    x[BUCKETS - 3] = 20 / (n + 20)
    at = np.flatnonzero(x)
    return at, np.sqrt(x[at])


def _voter(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for b in batches(frames):
        for t in utf8(b, "text"):
            if ws := (t or b"").split():
                k = pattern(votes(t, ws))
                counts[k] = counts.get(k, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def _sampled(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Features()
    for b in batches(frames, 8 << 20):
        rows = [(t, ws) for t in utf8(b, "text") if (ws := (t or b"").split())]
        got = [features(t, ws, memo) for t, ws in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([pattern(votes(t, ws)) for t, ws in rows], pa.int32()), pa.array([g[0].astype(np.int16).tobytes() for g in got], pa.binary()),
             pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary())], ["pattern", "at", "x"])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: full gradients with per-feature step sizes over the sample's rows."""
    w, b = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, b
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    size, size_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(row, x * w[at], len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        grad = np.bincount(at, x * err[row], BUCKETS) + DECAY * w
        size += grad ** 2
        size_b += err.sum() ** 2
        w -= RATE / 10 * grad / np.sqrt(size)
        b -= RATE / 10 * err.sum() / np.sqrt(size_b)
    return w, b


def _scorer(model):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Features()
        w, b0 = model.value
        for b in batches(frames):
            score = []
            for t in utf8(b, "text"):
                ws = (t or b"").split()
                if not ws:
                    score.append(0.0)
                    continue
                at, x = features(t, ws, memo)
                score.append(1 / (1 + float(np.exp(-np.clip(x @ w[at] + b0, -40, 40)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "quality"])

    return run


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, pd.DataFrame]:
    """(weights, intercept, labellers with their estimated accuracy)."""
    counts = docs.select("text").mapInArrow(_voter, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    share, p, post = expectation_maximisation(counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.float64), len(LABELLERS))
    accuracy = pd.DataFrame({"labeller": LABELLERS, "accuracy": share * p[:, 1] + (1 - share) * (1 - p[:, 0])})
    # the distinct texts with the smallest hashes: hashes first, so that only chosen texts move
    h = F.xxhash64("text", F.lit(2))
    edge = docs.where("text is not null").select(h.alias("h")).distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    sample = docs.where((h <= edge) if edge is not None else F.lit(False)).select("text").distinct().orderBy(h).limit(sample_rows)
    data = cut_lineage(sample).mapInArrow(_sampled, "pattern int, at binary, x binary").toPandas().sort_values(["pattern", "x", "at"])
    of = dict(zip(counts["pattern"], post))
    rows = [(np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(x, np.float32)) for a, x in zip(data["at"], data["x"])]
    w, b = fit_scorer(rows, np.array([of[k] for k in data["pattern"]]))
    return w, b, accuracy


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, quality (0 to 1) and kept for every row."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    w, b, _ = train(src, sample_rows)
    scored = src.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast((w, b))), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, quality double")
    return scored.withColumn("kept", F.col("quality") >= threshold)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(read(spark, folder, "documents"))
