"""Periodic runs of words by block convolution.

A run is a maximal stretch of words with smallest period q, at least ``LEAST`` words and two periods long. Scales are dyadic: blocks of L words,
aligned in their text, serve the periods 2L - 1 to 4L - 2 (the smallest blocks all below too). A run of such a period contains, before its last period,
an aligned block whole, which comes again q words later. So each block is slid over the window behind it: the sum of squared differences at every
distance comes from one exact integer number-theoretic transform, and a sum of zero marks an occurrence. Word numbers are written as digits so that no sum
reaches the modulus: zero means equal words, there is nothing to verify. Blocks side by side that come again at the same distance make a chain; a chain's
ends are less than L words from its run's ends, to which it is extended word by word. Of chains that fill the same stretch the smallest distance is the period.

Blocks with a word that does not come again within the window cannot occur there and are left out, so plain prose costs little. Texts are taken in batches of
bounded bytes; each row is on its own, nothing is shuffled. Cost: n log^2 n for repetitive texts of n words; texts of long runs of one word, broken at
lengths near a scale, may need n L comparisons in the extension.

Defined cases: a null text has no words (its collapsed text is empty); texts of fewer than ``LEAST`` words have no run; repeated rows are read each; an empty
table gives an empty result; very long texts are a batch of their own (about 200 bytes a word in the task). Other columns are kept as they are; columns named
like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batches, let, query, read, utf8

LEAST = 12  # words of a run
PRIME, ROOT = 15 * 2**27 + 1, 31  # transforms of up to 2**27 places
PLACES = 1 << 18  # of transforms that are held at once
ADDED = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    at = 1
    while at < n:
        out[at:2 * at] = out[:at] * np.uint64(pow(base, at, PRIME)) % np.uint64(PRIME)
        at *= 2
    return out


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in bit-reversed order."""
    p, n, a = np.uint64(PRIME), a.shape[1], a.astype(np.uint64)
    half = n // 2
    while half:
        w = _powers(pow(ROOT, (PRIME - 1) // (2 * half), PRIME), half)
        v = a.reshape(-1, 2, half)
        low, high = v[:, 0], v[:, 1]
        a = np.stack([(low + high) % p, (low + p - high) * w % p], 1).reshape(-1, n)
        half //= 2
    return a


def restore(a: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``."""
    p, n = np.uint64(PRIME), a.shape[1]
    half = 1
    while half < n:
        w = _powers(pow(ROOT, PRIME - 1 - (PRIME - 1) // (2 * half), PRIME), half)
        v = a.reshape(-1, 2, half)
        low, high = v[:, 0], v[:, 1] * w % p
        a = np.stack([(low + high) % p, (low + p - high) % p], 1).reshape(-1, n)
        half *= 2
    return a * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def digits(words: np.ndarray, size: int) -> list[np.ndarray]:
    """Word numbers as digits, so few and so small that sums over ``size`` words stay below the modulus."""
    many, count = int(words.max(initial=0)) + 1, 1
    while (base := isqrt((PRIME - 1) // (count * size))) ** count < many:
        count += 1
    return [words // base**k % base for k in range(count)]


def mismatches(planes: list[np.ndarray], blocks: np.ndarray, size: int, first: int, distances: int) -> np.ndarray:
    """Sum of squared differences of each block with the stretch ``first``, ``first`` + 1, ... words later."""
    n, last = 4 * size, len(planes[0]) - 1
    cross, squares = None, 0
    window = np.minimum(blocks[:, None] + first + np.arange(n), last)
    for digit in planes:
        x, y = digit[blocks[:, None] + np.arange(size)], digit[window]
        flipped = np.zeros((len(blocks), n), np.int64)
        flipped[:, :size] = x[:, ::-1]
        product = transform(flipped) * transform(y) % np.uint64(PRIME)
        cross = product if cross is None else (cross + product) % np.uint64(PRIME)
        before = np.concatenate([np.zeros((len(blocks), 1), np.int64), np.cumsum(y * y, 1)], 1)
        squares = squares + (x * x).sum(1)[:, None] + before[:, size:size + distances] - before[:, :distances]
    return squares - 2 * restore(cross)[:, size - 1:size - 1 + distances].astype(np.int64)


def _agree(words: np.ndarray, at: np.ndarray, distance: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """For how many words from ``at`` on, in the direction of ``step``, the word ``distance`` later is the same."""
    out = np.zeros(len(at), np.int64)
    for k in range(0, len(at), 1 << 15):
        part = np.arange(k, min(len(at), k + (1 << 15)))
        width, done = 8, 0
        while len(part):
            i = at[part, None] + step * (done + np.arange(width))
            far = done + np.arange(width) >= limit[part, None]
            i[far] = 0
            same = (words[i] == words[np.where(far, 0, i + distance[part, None])]) & ~far
            run = np.where(same.all(1), width, same.argmin(1))
            out[part] += run
            part = part[run == width]
            done += width
            width = min(2 * width, max(8, (1 << 20) // max(1, len(part))))
    return out


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs, by start and period. ``words`` holds the texts' word numbers one after the other, ``first`` where each begins and the total."""
    found, total = [np.empty((0, 3), np.int64)], len(words)
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end_of = first[1:][text]
    # how far it is to the next place of the same word in the text; of L words from each place on, the farthest
    order = np.argsort(text * (int(words.max(initial=0)) + 1) + words, kind="stable")
    follows = (words[order[1:]] == words[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    never = total + 1
    reach = np.full(total, never)
    reach[order[:-1][follows]] = (order[1:] - order[:-1])[follows]
    size, low = 1, 1
    while 2 * low <= lengths.max(initial=0):
        reach = np.maximum(reach, np.concatenate([reach[size:], np.full(min(size, total), never)]))[:total]
        size *= 2
        high = 4 * size - 2
        counts = lengths // size
        blocks = np.repeat(first[:-1], counts) + size * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        blocks = blocks[(reach[blocks] <= high) & (blocks + low + size <= end_of[blocks])]
        if len(blocks):
            planes, at, far = digits(words, size), [], []
            rows = max(1, PLACES // (4 * size))
            for k in range(0, len(blocks), rows):
                part = blocks[k:k + rows]
                r, d = np.nonzero(mismatches(planes, part, size, low, high - low + 1) == 0)
                inside = part[r] + low + d + size <= end_of[part[r]]
                at.append(part[r][inside])
                far.append(low + d[inside])
            at, far = np.concatenate(at), np.concatenate(far)
            order = np.lexsort([at, far])
            at, far = at[order], far[order]
            head = np.concatenate([[True], (far[1:] != far[:-1]) | (at[1:] != at[:-1] + size)])[:len(at)]
            tail = np.concatenate([head[1:], [True]])[:len(at)]
            start, end, far = at[head], at[tail] + size, far[head]
            if len(start):
                begin, stop = first[:-1][text[start]], end_of[start]
                start = start - _agree(words, start - 1, far, start - begin, -1)
                end = end + _agree(words, end, far, stop - far - end, 1)
                ok = (end - start >= far) & (end - start + far >= least)
                found.append(np.stack([start, end + far, far], 1)[ok])
        low = high + 1
    runs = np.concatenate(found)
    runs = runs[np.lexsort(runs.T[[2, 1, 0]])]
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])[:len(runs)]]  # the smallest period of a stretch
    return runs[np.lexsort(runs.T[[2, 0]])]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of the words no run has after its first period."""
    over = np.zeros(n + 1, np.int64)
    np.add.at(over, runs[:, 0] + runs[:, 2], 1)
    np.add.at(over, runs[:, 1], -1)
    return np.cumsum(over)[:n] == 0


def _marker(text: str, least: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 4 << 20):
            split = [t.split() if t else [] for t in utf8(b, text)]
            number: dict[bytes, int] = {}
            first = np.cumsum([0, *map(len, split)])
            words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, first[-1])
            runs = find_runs(words, first, least)
            cuts = np.searchsorted(runs[:, 0], first)
            collapsed = []
            for k, ws in enumerate(split):
                own = runs[cuts[k]:cuts[k + 1]] - [first[k], first[k], 0]
                collapsed.append(b" ".join(ws if not len(own) else [ws[i] for i in np.flatnonzero(_kept(len(ws), own))]))
            start = runs[:, 0] - np.repeat(first[:-1], np.diff(cuts))
            items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, runs[:, 1] - runs[:, 0], runs[:, 2])], ["start", "length", "period"])
            new = {"n_words": pa.array(np.diff(first), pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                   "collapsed": pc.cast(pa.array(collapsed, pa.binary()), options=pc.CastOptions.unsafe(pa.string()))}
            old = [c for c in b.schema.names if c not in ADDED and c != "__text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in old], *new.values()], [*old, *new])

    return run


def mark_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; numbered from 0, by start and period) and collapsed (the words that no run repeats, one space apart)."""
    rest = [c for c in docs.columns if c not in ADDED]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text"]
    return src.mapInArrow(_marker("__text", least), ", ".join([*fields, *[f"{c} {t}" for c, t in ADDED.items()]]))


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text of a document; where crc32(doc_id) divides by 10, the words from a place on repeat the first ones after it (the query's contract)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

    def planted(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(ws, lambda w, i: F.when(
            i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")))

    ws = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(ws, lambda ws: F.when(F.size(ws) > 0, planted(ws)))).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return mark_runs(docs).select("doc_id", "runs", "collapsed", top.alias("_top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"), F.expr("1000 * _top.length div -_top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
