"""MinHash near-duplicates with min-max hashing.

Every permutation of the shingle space is evaluated once per shingle and gives two signature values, the least and the
greatest hash; 96 permutations make the 192 values of 32 bands of six. A pair at similarity 0.85 shares no band with
probability below 1e-6. Shared bands propose, full shingle sets decide.

How a group of any size stays small: rows with equal sets are one class. Classes that share a band are candidates. Every
candidate is compared with one leader of its bands only, linked classes become components, and this is repeated. Where
bands still join different components, rarest-first prefixes of the full sets tell which pairs can reach the threshold at
all; those are compared one by one, so no link is lost. Sets are fetched for candidates only.

Defined cases: a null, empty or wordless text has an empty set and is linked with nothing; a text of fewer than ``width``
words is one shingle; a row without doc_id is linked with nothing and has no component; rows that share a doc_id are one
document and stay or go together. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.graph import components
from ..session import cut_lineage
from .common import batches, query, read, utf8, words

WIDTH, PERCENT = 5, 85
BANDS, ROWS = 32, 6  # ROWS is even: half of a band's values are minima, half are maxima of the same permutations
STAR_ROUNDS = 2
WORDS_HELD = 100_000  # words whose hashes a task remembers
_M = (1 << 64) - 1


class _WordHashes(dict):
    """64-bit hashes of words, computed once per word and task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(ws: list[bytes], width: int, memo: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    k = min(width, len(ws))
    acc = np.full(len(ws) - k + 1, k, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j:len(ws) - k + 1 + j]
    return np.unique(_mix(acc))


class MinMax:
    """Least and greatest value of each permutation, folded into band keys."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.a = rng.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)
        self.bands = bands

    def band_keys(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        for at in range(0, len(x), 2048):
            y = self.a * x[at:at + 2048] + self.b
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        v = (low.astype(np.uint64) << np.uint64(32) | high).reshape(self.bands, -1)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(v.shape[1]):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ v[:, j])
        return key.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _signer(width: int, bands: int, rows: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, signer, none = _WordHashes(), MinMax(bands, rows), np.empty(0, np.int64)
        for b in batches(frames):
            ids, n, keys, digests = b.column("doc_id").to_pylist(), [], [], []
            for i, t in zip(ids, utf8(b, "text")):
                s = shingle_set(words(t), width, memo)
                n.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                digests.append((d >> 64, d & _M))
                keys.append(signer.band_keys(s) if len(s) and i is not None else none)
            d = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(keys)],
                                             ["doc_id", "n", "d1", "d2", "keys"])

    return run


def _setter(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for b in batches(frames, 8 << 20):
            sets = list(starmap(lambda t: shingle_set(words(t), width, memo).view(np.int64), zip(utf8(b, "text"))))
            keys = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys), _lists(sets)], ["id", "set", "shingles"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return cut_lineage(pairs.join(left, "a").join(right, "b")
                       .where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b"))


def _remaining_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components of ``live(id, comp)`` that may reach the threshold; every such pair that does is among them.

    Each set is sorted rarest shingle first. Two similar sets share a shingle among the first ones of both, and what
    follows the first shared one bounds their overlap, so pairs that only share what their whole group shares never arise.
    """
    token = (sets.join(live, "id").select("id", "set", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("s")))
    often = cut_lineage(token.groupBy("s").agg(F.count(F.lit(1)).alias("df")))
    order = Window.partitionBy("id", "set").orderBy("df", "s")
    need = F.ceil(F.col("n") * percent / 100.0 - 1e-9)
    head = cut_lineage(token.join(often, "s").withColumn("pos", F.row_number().over(order))
                       .where((F.col("pos") <= F.col("n") - need + 1) & (F.col("df") > 1)).drop("df"))
    a, b = (head.select("s", *[F.col(c).alias(f"{side}{c}") for c in ("id", "comp", "n", "pos")]) for side in "ab")
    most = 1 + F.least(F.expr("an - apos"), F.expr("bn - bpos"))
    return (a.join(b, "s").where((F.col("acomp") < F.col("bcomp")) & (100 * most >= percent * (F.col("an") + F.col("bn") - most)))
            .select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = src.mapInArrow(_signer(width, bands, rows), "doc_id long, n long, d1 long, d2 long, keys array<long>")
    signed = cut_lineage(signed)
    classes = cut_lineage(signed.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))  # so that a hot class is split in the join
    member = cut_lineage(signed.where("n > 0 and doc_id is not null").drop("keys").join(classes, ["d1", "d2"]).select("doc_id", "n", "rep"))
    leads = member.where("doc_id = rep").select(F.col("rep").alias("doc_id")).distinct()
    bands_of = signed.where("n > 0").join(leads, "doc_id").select(F.col("doc_id").alias("id"), "n", F.explode("keys").alias("key"))

    # Candidates: classes with a band in common.
    shared = cut_lineage(bands_of.groupBy("key").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select("key"))
    cells = cut_lineage(bands_of.join(shared, "key"))
    wanted = cells.select("id").distinct()
    # One row per document and set: rows that repeat a doc_id are fetched apart and their equal sets taken once.
    repeated = cut_lineage(signed.where("n > 0").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                           .join(wanted, "id", "left_semi").select("id"))
    texts = src.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "id")
    fetch = lambda ids: texts.join(ids, "id", "left_semi").mapInArrow(_setter(width), "id long, set long, shingles array<long>")
    if repeated.isEmpty():
        sets = cut_lineage(fetch(wanted))
    else:
        sets = cut_lineage(fetch(wanted.join(repeated, "id", "left_anti")).union(fetch(repeated).dropDuplicates(["id", "set"])))
    links = None
    labels = cells.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(star_rounds + 1):
        # cells of the bands that still join different components
        at = cells.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
        mixed = cut_lineage(at.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("key"))
        live = cut_lineage(at.join(mixed, "key"))
        if live.isEmpty():
            break
        if turn < star_rounds:
            # one leader per band, the first row or a random one; one leader per class, the one with the most bands in common
            rank = -F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            lead = cut_lineage(live.groupBy("key").agg(F.max_by(F.struct("id", "n", "comp"), rank).alias("_h")))
            lead = lead.select("key", *[F.col(f"_h.{c}").alias(f"_{c}") for c in ("id", "n", "comp")])
            near = live.join(lead, "key").where((F.col("comp") != F.col("_comp")) & (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")))
            near = near.groupBy("id", "_id").agg(F.count(F.lit(1)).alias("c"))
            pairs = near.groupBy("id").agg(F.max_by("_id", "c").alias("b")).select(F.col("id").alias("a"), "b")
        else:
            pairs = _remaining_pairs(live.select("id", "comp").distinct(), sets, percent)
        found = _linked(pairs, sets, percent)
        links = found if links is None else links.union(found)
        labels = components(links)
    out = (member.join(labels, F.col("rep") == F.col("node"), "left")
           .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
           .union(signed.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose document is a near copy of one with a smaller doc_id."""
    gone = near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


@query("op8_minhash_near_dedup", """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))
