"""Language-model scores from a probabilistic suffix tree over the bytes of the token stream.

A text is lower-cased (A-Z) and read as words; each word is followed by a blank, the last one by the end symbol, so a text's
tokens and its byte stream stand for each other one to one. Tree nodes are contexts of up to ``DEPTH`` bytes, across
word borders too. A context is kept if it was seen ``LEAST`` times in training (a number below 1 is a share of the
positions) and its next-symbol counts diverge from those of its longest kept suffix (count-weighted Kullback-Leibler
divergence of at least ``GAIN`` nats). Next-symbol distributions are smoothed towards that suffix. A text's score is the
sum over its stream, at each place from the state of the longest kept context that the stream ends with.

The tree is a distributed table and grows with the corpus: for every gram (context and next symbol) of any text, its
training count and its probability, made from the shorter grams' by one join a level. Rows are taken in chunks; each chunk
asks for its distinct grams once and gets their probabilities by an equi-join, next to its texts. Counting is one pass with
sums per task before the shuffle. Words are counted whole, by a 64-bit key of the word; counts of words above ``COMMON``
(at most 1 / COMMON of them) go to the tasks, all others meet their words in a join.

Defined cases: a null text counts as empty and is one end token; a row without doc_id is held out; repeated rows are
scored each; without training rows N = V = 0, every base probability is 1 and the model is uniform over bytes. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import batches, query, read, utf8, words

DEPTH, LEAST, GAIN, PRIOR = 5, 16, 15.0, 8.0  # a context and its next byte make up a 64-bit key: DEPTH is 7 at most
COMMON = 1e-6
START, END = b"\n", b"\xff"  # neither occurs in a word
CHUNK_BYTES = 16 << 20  # texts of a chunk: rows of one partition that lie together, as many as have this size on average
_END_KEY = np.array([xxhash.xxh3_64_intdigest(END)], np.uint64).view(np.int64)[0].item()


def stream(ws: list[bytes]) -> bytes:
    return b" ".join([*ws, END]) if ws else END


def grams_of(pieces: list[bytes], d: int) -> np.ndarray:
    """(context, next symbol) as integers for each byte of the pieces but the first ``d`` of each, which are context only."""
    a = np.frombuffer(b"".join(pieces), np.uint8)
    fresh = np.ones(len(a), bool)
    at = 0
    for x in pieces:
        fresh[at:at + d] = False
        at += len(x)
    wide = a.astype(np.uint64)
    g = np.zeros(len(a) - d, np.uint64)
    for j in range(d + 1):
        g = g << np.uint64(8) | wide[j:len(a) - d + j]
    return g[fresh[d:]]


class _Grams:
    """Counts of (context, next symbol) as integers of DEPTH + 1 bytes, merged in bounded pieces."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.size = depth, [], 0
        self.buffer: list[bytes] = []
        self.waiting = 0

    def add(self, text: bytes) -> None:
        pad = START * self.depth
        for at in range(0, len(text), 2 << 20):  # very long texts in pieces, each with the bytes before it
            piece = (pad + text[:2 << 20]) if at == 0 else text[at - self.depth:at + (2 << 20)]
            self.buffer.append(piece)
            self.waiting += len(piece)
            if self.waiting > 2 << 20:
                self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        self.parts.append(np.unique(grams_of(self.buffer, self.depth), return_counts=True))
        self.size += len(self.parts[-1][0])
        self.buffer, self.waiting = [], 0
        if self.size > 1_500_000:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, n = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.parts = [(keys[first], np.add.reduceat(n, first))]
        self.size = sum(len(p[0]) for p in self.parts)


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 200_000):
        k = keys[at:at + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[at:at + 200_000].astype(np.int64))],
                                         ["kind", "key", "n"])


def _counter(depth: int):
    def words_out(seen: Counter) -> Iterator[pa.RecordBatch]:
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        yield from _rows(0, keys, np.fromiter(seen.values(), np.int64, len(seen)))
        seen.clear()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        taught, asked = _Grams(depth), _Grams(depth)
        for b in batches(frames, 8 << 20):
            for t, held in zip(utf8(b, "text"), b.column("held_out").to_pylist()):
                ws = words(t)
                (asked if held else taught).add(stream(ws))
                if not held:
                    seen.update(ws)
                    seen[END] += 1
            if len(seen) > 400_000:
                yield from words_out(seen)
            if taught.size + asked.size > 1_000_000:
                yield from _gram_rows(taught, asked, 1_000_000)
        yield from words_out(seen)
        yield from _gram_rows(taught, asked, 0)

    return run


def _gram_rows(taught: _Grams, asked: _Grams, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the grams; those that are only asked for count 0."""
    for grams in (taught, asked):
        grams.flush()
        grams.merge()
    if taught.size + asked.size > least:
        for grams in (taught, asked):
            for keys, n in grams.parts:
                yield from _rows(1, keys, n if grams is taught else np.zeros_like(n))
            grams.parts, grams.size = [], 0


def _chunk_grams(depth: int):
    """The distinct grams of every chunk; rows of a chunk lie together."""
    def out(chunk: int, grams: _Grams) -> Iterator[pa.RecordBatch]:
        grams.flush()
        grams.merge()
        for keys, _ in grams.parts:
            for at in range(0, len(keys), 200_000):
                k = keys[at:at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk, np.int64)), pa.array(k.view(np.int64))], ["chunk", "key"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grams = None, _Grams(depth)
        for b in batches(frames, 8 << 20):
            for t, chunk in zip(utf8(b, "text"), b.column("chunk").to_pylist()):
                if chunk != at:
                    yield from out(at, grams)
                    at, grams = chunk, _Grams(depth)
                grams.add(stream(words(t)))
        yield from out(at, grams)

    return run


def planes(keys: np.ndarray) -> bytes:
    """Keys byte by byte, all highest bytes together and so on: those of ascending keys compress well on their way."""
    return keys.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams and probabilities of a chunk side by side, in few rows."""
    def out() -> pa.RecordBatch:
        chunk, key, logp = (np.concatenate([p[k] for p in waiting]) for k in range(3))
        order = np.argsort(chunk, kind="stable")
        chunk, key, logp = chunk[order], key[order], logp[order]
        first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        ends = [*first[1:], len(chunk)]
        cols = [pa.array(chunk[first]), *[pa.array([f(v[s:e]) for s, e in zip(first, ends)], pa.binary()) for f, v in ((planes, key), (np.ndarray.tobytes, logp))]]
        return pa.RecordBatch.from_arrays(cols, ["chunk", "keys", "logps"])

    waiting, size = [], 0
    for b in frames:
        if b.num_rows:
            waiting.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "key", "logp")])
            size += b.num_rows
        if size > 500_000:
            yield out()
            waiting, size = [], 0
    if size:
        yield out()


_EMPTY = np.uint64(2**64 - 1)  # no gram: END occurs once in a stream
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """log10 probabilities of the grams of one chunk, found by hash: a gram's place is the first of the slots from its own on that holds it."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.keys, self.logp = depth, [], None, None

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (grams * _SPREAD >> self.shift).astype(np.int64)

    def _fill(self) -> None:
        keys = np.concatenate([np.empty(0, np.uint64), *[from_planes(k) for k, _ in self.parts]])
        logp = np.frombuffer(b"".join(p for _, p in self.parts), np.float64)
        self.parts = []
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.logp = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[free]  # of several for one slot the last one stays
            self.logp[at[free]] = logp[free]
            again = self.keys[at] != keys
            keys, logp, at = keys[again], logp[again], (at[again] + 1) & self.last

    def find(self, grams: np.ndarray) -> np.ndarray:
        at = self._slot(grams)
        open_at = np.flatnonzero(self.keys[at] != grams)
        while len(open_at):
            if (self.keys[at[open_at]] == _EMPTY).any():
                raise RuntimeError("the rows changed between two passes: a gram without a probability")
            at[open_at] = (at[open_at] + 1) & self.last
            open_at = open_at[self.keys[at[open_at]] != grams[open_at]]
        return self.logp[at]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.keys is None:
            self._fill()
        out = np.zeros(len(texts))
        row, waiting, size = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), 1 << 20):  # very long texts in pieces, each with the bytes before it
                waiting.append((START * self.depth + t)[at:at + (1 << 20) + self.depth] if len(t) > 1 << 20 else START * self.depth + t)
                row.append(i)
                size += len(waiting[-1])
                if size > 1 << 18:  # numbers of that many places stay in the processor's cache
                    self._add(out, row, waiting)
                    row, waiting, size = [], [], 0
        if waiting:
            self._add(out, row, waiting)
        return out

    def _add(self, out: np.ndarray, row: list[int], pieces: list[bytes]) -> None:
        logp = self.find(grams_of(pieces, self.depth))
        first = np.cumsum([0] + [len(x) - self.depth for x in pieces[:-1]])
        np.add.at(out, row, np.add.reduceat(logp, first))


def _scorer(depth: int, common, n_all: int, n_words: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = None, None
        known = dict(zip(*(x.tolist() for x in common.value)))
        floor = n_all + 0.1 * (n_words + 1)
        memo: dict[bytes, tuple[float, int]] = {}
        for whole in batches(frames, 8 << 20):
            for (chunk, is_text), rows in groupby(enumerate(zip(whole.column("chunk").to_pylist(), whole.column("is_text").to_pylist())), lambda x: x[1]):
                rows = [i for i, _ in rows]
                b = whole.slice(rows[0], len(rows))
                if chunk != at:
                    at, model = chunk, _Table(depth)
                if not is_text:
                    model.parts += zip(b.column("keys").to_pylist(), b.column("logps").to_pylist())
                    continue
                n, seen, base, rare, texts = [], [], [], [], []
                for t in utf8(b, "text"):
                    ws = words(t)
                    texts.append(stream(ws))
                    parts, open_keys, hits = [], [], 0
                    for w in [*ws, END]:
                        got = memo.get(w)
                        if got is None:
                            if len(memo) > 150_000:
                                memo.clear()
                            key = int(np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64))
                            c = known.get(key)
                            got = memo[w] = (math.log10((c + 0.1) / floor), 0) if c else (1.0, key)
                        if got[0] > 0.5:
                            open_keys.append(got[1])
                        else:
                            hits += 1
                            parts.append(got[0])
                    n.append(len(ws) + 1)
                    seen.append(hits)
                    base.append(math.fsum(parts))
                    rare.append(open_keys)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()),
                     pa.array(model.score(texts)), pa.array(rare, pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    return run


def _probabilities(grams: DataFrame, depth: int, least: float, gain: float, prior: float) -> DataFrame:
    """(key, logp) for every gram of ``grams(key, n)``."""
    levels = [grams]
    for d in range(depth - 1, -1, -1):
        levels.append(cut_lineage(levels[-1].groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))))
    if least < 1:
        least *= levels[-1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    p = None
    for d, level in enumerate(levels[::-1]):
        level = level.select("key", "n", F.shiftrightunsigned("key", 8).alias("ctx"))
        if d == 0:
            level = level.withColumn("below", F.lit(1 / 256))
        else:
            level = level.withColumn("_low", F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(p.select(F.col("key").alias("_low"), F.col("p").alias("below")), "_low").drop("_low")
        told = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("below"))).otherwise(F.lit(0.0))
        of_ctx = level.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(told).alias("told"), F.collect_list(F.struct("key", "n", "below")).alias("next"))  # at most 256
        kept = F.col("total") > 0
        if d:
            kept = kept & (F.col("total") >= least) & (F.col("told") - F.col("total") * F.log(F.col("total").cast("double")) >= gain)
        p = (of_ctx.select("total", kept.alias("kept"), F.inline("next"))
             .select("key", F.when(F.col("kept"), (F.col("n") + prior * F.col("below")) / (F.col("total") + prior)).otherwise(F.col("below")).alias("p")))
    return p.select("key", F.log10("p").alias("logp"))


def train(src: DataFrame, depth: int = DEPTH, least: float = LEAST, gain: float = GAIN, prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(key, logp) for the grams of all rows of ``src(text, held_out)``, learnt from those not held out, and the latter's word counts (key, n)."""
    counts = src.select("text", "held_out").mapInArrow(_counter(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    return _probabilities(counts.where("kind = 1").select("key", "n"), depth, least, gain, prior), counts.where("kind = 0").select("key", "n")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", common: float = COMMON, depth: int = DEPTH, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.crc32(key.cast("binary")) % 10 == 0).alias("held_out"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size, rows = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    # a partition's rows are numbered from 0 on; its number stands above the 33rd bit
    in_chunk = max(1, int(CHUNK_BYTES * rows / max(1, size)))
    number = F.monotonically_increasing_id()
    src = src.withColumn("chunk", F.shiftright(number, 33) * (1 << 33) + F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / in_chunk))
    logps, counts = train(src, depth, **how)
    n_all, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    spark = docs.sparkSession
    often = counts.where(F.col("n") >= max(1, common * n_all)).toPandas()  # at most 1 / common rows
    tables = (often["key"].to_numpy(np.int64), often["n"].to_numpy(np.int64))
    bc = spark.sparkContext.broadcast
    id_type = src.schema["doc_id"].dataType.simpleString()
    asked = src.select("chunk", "text").mapInArrow(_chunk_grams(depth), "chunk long, key long").join(logps, "key").select("chunk", "key", "logp")
    packed = asked.mapInArrow(_pack, "chunk long, keys binary, logps binary").withColumn("is_text", F.lit(False))
    # a chunk's probabilities, then its texts
    both = packed.unionByName(src.withColumn("is_text", F.lit(True)), allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "is_text")
    scored = both.mapInArrow(_scorer(depth, bc(tables), n_all, n_words),
                            f"doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>")
    scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
    # Words that are not common meet their counts; sums go back to their row.
    c = F.coalesce("n", F.lit(0))
    open_words = scored.select("_row", F.explode("rare").alias("key"))
    rest = (open_words.join(counts, "key", "left").groupBy("_row")
            .agg(F.sum(F.log10((c + 0.1) / F.lit(n_all + 0.1 * (n_words + 1)))).alias("_base"), F.sum((c > 0).cast("long")).alias("_known")))
    zero = F.lit(0).cast("long")
    return scored.drop("rare").join(rest, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", zero)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score")


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score(read(spark, folder, "documents"))
