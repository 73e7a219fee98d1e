"""Toxicity by a classifier chain over categories.

Each category has a linear model over the distinct words of a text; the model of a later category also sees the
probabilities of the earlier ones. While training, those are out-of-fold predictions, so that a later model learns how good
earlier ones are on texts they have not seen; when scoring, the models of all rows are applied one after the other.

The labels table says whether a text is toxic, which is the last category; the categories before it are told apart among
toxic texts by seed words (``SEEDS``). Models are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with
the smallest seeded hash of doc_id). All words enter that, over the sample, occur in ``MIN_DOCS`` rows and differ between
the classes by ``MIN_Z`` standard errors in some category. The fit keeps rows as lists of their words, so its memory follows the words found, not rows times words. Scoring is one pass over
all texts, nothing exchanged.

Defined cases: a null or empty text has no words and gets the chain's base probabilities; labels that are null or whose
doc_id is not found are not used; if several labels stand for one doc_id the largest counts; without labelled rows of
both classes every probability is the share of the class (0 without any) and nothing is rejected. Rows with equal texts
get equal results. Rows keep all their columns; the result's own columns replace others of that name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage
from .common import batches, query, read, utf8
from .decontamination import item_words as _words

# Fixed seed words of the categories before the last.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "dumb", "clown", "loser", "fool", "jerk"),
    "degrading": ("trash", "scum", "vermin", "worthless", "garbage", "filth", "subhuman"),
    "contempt": ("disgusting", "pathetic", "despicable", "hateful", "repulsive", "shameful"),
}
CATEGORIES = (*SEEDS, "toxic")
SAMPLE_ROWS, FOLDS, MIN_DOCS, MIN_Z, THRESHOLD = 20_000, 5, 5, 4.0, 0.5
RIDGE, STEPS, INNER = 0.1, 30, 60
PREFIXES = (4, 5, 6, 7)  # bytes
WORDS_HELD = 100_000  # distinct words that a counting task holds before it passes their counts on


def features(text: bytes | None) -> set[bytes]:
    """Distinct words, and beginnings of words (marked by a trailing blank): inflected forms share them."""
    ws = set(_words(text))
    return ws.union(*({w[:k] + b" " for w in ws if len(w) > k} for k in PREFIXES))


@dataclass
class Chain:
    """Weights of the categories in order: per word, per earlier category, and an intercept."""

    words: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # categories x words
    earlier: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # categories x categories
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, found: list[list[int]]) -> np.ndarray:
        """Probabilities (rows x categories) of rows given as lists of word numbers."""
        x = np.zeros((len(found), len(self.bias)))
        for i, f in enumerate(found):
            if f:
                x[i] = self.weights[:, f].sum(axis=1)
        p = np.zeros_like(x)
        for j in range(x.shape[1]):
            p[:, j] = _sigmoid(x[:, j] + self.bias[j] + p[:, :j] @ self.earlier[j, :j])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Rows as the words in them (row and word numbers, side by side) and some dense columns."""

    def __init__(self, row: np.ndarray, word: np.ndarray, words: int, dense: np.ndarray):
        self.row, self.word, self.words, self.dense = row, word, words, dense

    def times(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, theta[self.word], len(self.dense)) + self.dense @ theta[self.words:-1] + theta[-1]

    def back(self, value: np.ndarray, square: bool = False) -> np.ndarray:
        dense = self.dense**2 if square else self.dense
        return np.concatenate([np.bincount(self.word, value[self.row], self.words), dense.T @ value, [value.sum()]])

    def subset(self, keep: np.ndarray) -> Rows:
        number = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Rows(number[self.row[mine]], self.word[mine], self.words, self.dense[keep])


def fit_logistic(x: Rows, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients; the intercept is free."""
    n, k = len(y), x.words + x.dense.shape[1]
    share = np.clip(y.mean() if n else 0.0, 1e-9, 1 - 1e-9)
    theta = np.append(np.zeros(k), float(np.log(share / (1 - share))))
    if y.min(initial=1) == y.max(initial=0):
        return theta[:-1], theta[-1]
    penalty = np.append(np.full(k, ridge), 1e-6)
    for _ in range(steps):
        p = _sigmoid(x.times(theta))
        spread = p * (1 - p)
        left = -(x.back(p - y) + penalty * theta)
        scale = 1 / (x.back(spread, square=True) + penalty)
        move, target = np.zeros(k + 1), 1e-8 * np.linalg.norm(left)
        z = scale * left
        d, size = z.copy(), left @ z
        for _ in range(INNER):
            if np.linalg.norm(left) <= target:
                break
            hd = x.back(spread * x.times(d)) + penalty * d
            a = size / (d @ hd)
            move += a * d
            left = left - a * hd
            z = scale * left
            size, before = left @ z, size
            d = z + size / before * d
        theta += move * min(1.0, 5 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return theta[:-1], float(theta[-1])


def fit_chain(names: list[bytes], row: np.ndarray, word: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
    """The chain for rows that hold words (side by side in ``row`` and ``word``) and category labels ``y`` (rows x categories)."""
    n, cats = y.shape
    chain = Chain(names, np.zeros((cats, len(names))), np.zeros((cats, cats)), np.zeros(cats))
    oof = np.zeros((n, cats))
    for j in range(cats):
        # later models see what earlier ones say of texts that those have not seen
        x = Rows(row, word, len(names), oof[:, :j].copy())
        for f in range(folds):
            rest = fold != f
            if rest.any() and not rest.all():
                w, b = fit_logistic(x.subset(rest), y[rest, j])
                oof[~rest, j] = _sigmoid(x.subset(~rest).times(np.append(w, b)))
        w, b = fit_logistic(x, y[:, j])
        chain.weights[j], chain.earlier[j, :j], chain.bias[j] = w[:len(names)], w[len(names):], b
    return chain


def _labels_of(found: set[bytes], toxic: int) -> list[int]:
    return [int(bool(toxic) and any(s.encode() in found for s in SEEDS[c])) for c in SEEDS] + [int(bool(toxic))]


def _word_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: the rows with it, and those of each category."""
    seen: Counter = Counter()
    by = [Counter() for _ in CATEGORIES]

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(seen)
        cols = [pa.array(keys, pa.binary()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([[c[k] for c in by] for k in keys], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["word", "n", "per"])
        for c in (seen, *by):
            c.clear()

    for b in batches(frames):
        for t, toxic in zip(utf8(b, "text"), b.column("_toxic").to_pylist()):
            found = features(t)
            seen.update(found)
            for c, y in zip(by, _labels_of(found, toxic)):
                if y:
                    c.update(found)
        if len(seen) > WORDS_HELD:
            yield from out()
    yield from out()


def _vectors(names: list[bytes]):
    at = {w: i for i, w in enumerate(names)}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            rows, ys = [], []
            for t, toxic in zip(utf8(b, "text"), b.column("_toxic").to_pylist()):
                found = features(t)
                rows.append(sorted(at[w] for w in at.keys() & found))
                ys.append(_labels_of(found, toxic))
            yield pa.RecordBatch.from_arrays([b.column("_fold"), pa.array(ys, pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.int32()))], ["fold", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain:
    """A chain fitted on at most ``sample_rows`` labelled rows."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
             .orderBy(F.xxhash64("_id", F.lit(4)), "_id").limit(sample_rows))
    sample = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # bounded by sample_rows
                         .groupBy("text").agg(F.max("_toxic").alias("_toxic"))  # copies teach once
                         .withColumn("_fold", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(folds)).cast("int")))
    rows, *positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    if not rows or not 0 < positive[0] < rows:
        share = min(max((positive[0] / rows) if rows else 0.0, 1e-9), 0.49)
        cats = len(CATEGORIES)
        return Chain([], np.zeros((cats, 0)), np.zeros((cats, cats)), np.full(cats, np.log(share / (1 - share))))
    counts = sample.mapInArrow(_word_counts, "word binary, n long, per array<long>").groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("per", k)).alias(f"c{k}") for k in range(len(CATEGORIES))]).where(F.col("n") >= MIN_DOCS)
    # standard errors between the share of a category's rows among those with the word, and the share of toxic rows among all
    share = F.lit(positive[0] / rows)
    strength = F.greatest(*[(F.col(f"c{k}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share)) for k in range(len(CATEGORIES))])
    best = counts.select("word", strength.alias("z")).where(F.col("z") >= MIN_Z)
    names = sorted(bytes(r[0]) for r in best.collect())  # of MIN_DOCS of the sampled rows each
    data = sample.mapInArrow(_vectors(names), "fold int, y array<int>, x array<int>").toPandas()
    rows = sorted(zip(data["fold"].tolist(), map(tuple, data["y"]), map(tuple, data["x"])))  # whole rows: the fit must not depend on their order of arrival
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    word = np.fromiter((k for r in rows for k in r[2]), np.int64, len(row))
    return fit_chain(names, row, word, np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), folds)


def _scorer(chain: Chain, extra: bool, threshold: float):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(chain.words)}
        known = frozenset(at)
        for b in batches(frames):
            p = chain.predict([[at[w] for w in sorted(known & features(t))] for t in utf8(b, "text")])
            toxic = p[:, -1] >= threshold
            if extra:
                more = {**{f"p_{c}": pa.array(p[:, j]) for j, c in enumerate(CATEGORIES)}, "toxic": pa.array(toxic)}
                cols = {**dict(zip(b.schema.names, b.columns)), **more}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
            else:
                yield b.filter(pa.array(~toxic))

    return run


RESULT = (*[f"p_{c}" for c in CATEGORIES], "toxic")


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a probability per category and ``toxic``."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT])
    schema = T.StructType(list(rest.schema.fields))
    for c in RESULT:
        schema = schema.add(c, "boolean" if c == "toxic" else "double")
    return rest.mapInArrow(_scorer(chain, True, threshold), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose probability of being toxic is below the threshold, with their own columns."""
    return docs.mapInArrow(_scorer(train(docs, labels), False, threshold), docs.schema)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    chain = train(docs, read(spark, folder, "labels"))
    return score(docs, chain).select("doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic", (~F.col("toxic")).alias("kept"))
