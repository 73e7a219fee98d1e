"""Vector search over cells: an exact k-nearest join that skips far cells, and an approximate one over compressed residuals.

The index is cut into cells around centres fitted on a bounded sample, cells into rings of like distance to the centre, rings into blocks of about ``BLOCK`` rows (so a hot cell is many
blocks). The score of a query q with any row of a ring is at most what the triangle inequality allows from |q - centre| and the ring's least and greatest distance. Queries visit rings by
falling bound in waves; after a wave the k-th score found is the bar, and a query goes on only to rings that can still reach it. A query with fewer than k rows has no bar and goes on, so it gets k
rows wherever the index has them. Tiles of one query block and one index block are scored by a matrix product; a tile's rows are bounded, whatever the skew.

With ``codes`` blocks hold product-quantised residuals (one byte for each ``CODE_WIDTH`` dimensions) in place of vectors. The best ``refine`` * k by approximate score meet their vectors in a join on the
id and are ranked exactly: the only loss is a true neighbour below that shortlist.

Held by the driver and every task: centres (``LISTS`` at most), code books, and four numbers for each ring; when categories make more than ``HELD_RINGS`` of them, rings meet the queries of their
category in a join and all of that category are scored. Fitting sample: the ``sample`` rows with the smallest hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ordering import top_per_group
from ..session import cut_lineage, small_batches, spread

BLOCK, QUERY_ROWS = 4096, 1024
LISTS, RINGS, SAMPLE = 4096, 8, 50_000
CODE_WIDTH, CODE_ROWS = 4, 10_000
HELD_RINGS = 1 << 20
HELD_BYTES, TILE_BATCH = 64 << 20, 8  # bytes of the index that a task of the product holds, and pairs of blocks that lie in memory
HELD_SCORES = 1 << 20  # numbers in a matrix of distances or bounds
CLOSE = 1e-9
_HITS = "qid long, id long, score double"


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)


def cell_count(n: int) -> int:
    """Cells for ``n`` rows: their square root, within bounds."""
    return min(LISTS, max(1, isqrt(n)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; distances are held for some rows at a time, so memory does not grow with the number of centres."""
    square, step = (centres**2).sum(1), max(1, HELD_SCORES // len(centres))
    return np.concatenate([np.argmin(square - 2 * (x[i:i + step] @ centres.T), axis=1) for i in range(0, max(1, len(x)), step)])


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Centres of at most ``k`` cells of the sample ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([_nearest(x[i:i + 4096], centres) for i in range(0, len(x), 4096)])
        n = np.bincount(cell, minlength=len(centres))
        order = np.argsort(cell, kind="stable")
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[n > 0])[:-1]]), axis=0)
        centres = centres.copy()
        centres[n > 0] = sums / n[n > 0, None]
    return centres


def sample_vectors(index: DataFrame, rows: int) -> np.ndarray:
    """Unit vectors of the ``rows`` rows with the smallest hashes of their ids."""
    h = F.xxhash64("id")
    got = index.select("vec", h.alias("_h")).orderBy("_h").limit(rows).toPandas()  # bounded by the caller's number
    return unit(np.stack(got["vec"].to_list())) if len(got) else np.zeros((0, 1))


class Codes:
    """Code books for residuals: ``CODE_WIDTH`` dimensions a byte."""

    def __init__(self, residuals: np.ndarray):
        self.dims = residuals.shape[1]
        self.books = [k_means(part, 256, 6) for part in self._parts(residuals)]

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        wide = np.pad(x, ((0, 0), (0, -self.dims % CODE_WIDTH)))
        return [wide[:, i:i + CODE_WIDTH] for i in range(0, wide.shape[1], CODE_WIDTH)]

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(p, b) for p, b in zip(self._parts(residuals), self.books)], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of unit vectors from the distance between q - centre and the coded residuals: in a narrow cell that is far more exact than the dot product."""
        gap = q - centre
        out = np.repeat(1 - (gap**2).sum(1, keepdims=True) / 2, len(codes), axis=1)
        for m, (part, book) in enumerate(zip(self._parts(gap), self.books)):
            out += (part @ book.T - (book**2).sum(1) / 2)[:, codes[:, m]]
        return out


def upper_bounds(q: np.ndarray, centres: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The most that queries (unit vectors or zero) can score in rings (cell, least and greatest distance to its centre, whether all rows have unit length)."""
    dot = q @ centres.T
    far = np.sqrt(np.maximum(0.0, (q**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * dot))[:, cell]
    gap = np.maximum(0.0, np.maximum(far - high, low - far))
    by_angle = 1.0 - gap**2 / 2
    by_length = dot[:, cell] + np.linalg.norm(q, axis=1)[:, None] * high
    return np.where(units & (np.linalg.norm(q, axis=1)[:, None] > 0.5), np.minimum(by_angle, by_length), by_length) + 1e-8


def best_of(q: np.ndarray, qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a tile per query; equal scores go to the lower id, so the cut into blocks does not matter. ``ids`` ascend."""
    k = min(k, len(ids))
    scores = np.round(scores, 12)
    kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    picks = []
    for row, edge in zip(scores, kth):
        above = np.flatnonzero(row > edge)
        picks.append(np.concatenate([above, np.flatnonzero(row == edge)[:k - len(above)]]))
    order = np.array(picks)
    return pd.DataFrame({"qid": np.repeat(qids, k), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})


class Best:
    """The k best rows of a stream of batches for a block of queries (unit vectors). Its size depends on neither the number of batches nor the copies in them."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int):
        self.qids, self.q, self.k = qids, q, k
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(len(q), -np.inf)  # k-th score so far

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """``ids`` ascend."""
        scores = self.q @ x.T
        reach = scores >= self.bar[:, None] - 1e-11  # scores are compared after rounding to 12 digits
        n = reach.sum(axis=1)
        many = n > 4 * self.k + 16  # first batches and groups of copies: cut to k at once
        few = np.flatnonzero((n > 0) & ~many)
        r, c = np.nonzero(reach[few])
        at, found, score = few[r], ids[c], np.round(scores[few[r], c], 12)
        if many.any():
            cut = best_of(scores[many], np.flatnonzero(many), ids, scores[many], self.k)
            at, found, score = (np.concatenate([a, cut[b].to_numpy()]) for a, b in ((at, "qid"), (found, "id"), (score, "score")))
        if not len(at):
            return
        at, found, score = np.concatenate([self.at, at]), np.concatenate([self.ids, found]), np.concatenate([self.scores, score])
        order = np.lexsort((found, -score, at))
        at, found, score = at[order], found[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        held = rank < self.k
        self.at, self.ids, self.scores = at[held], found[held], score[held]
        full = rank == self.k - 1
        self.bar[at[full]] = score[full]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.qids[self.at], "id": self.ids, "score": self.scores})


def _placed(centres):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = unit(np.stack(f["vec"].to_list()))
                cell = _nearest(x, centres.value)
                yield pd.DataFrame({"id": f["id"], "cat": f["cat"], "cell": cell.astype(np.int32), "far": np.linalg.norm(x - centres.value[cell], axis=1),
                                    "unit": np.linalg.norm(x, axis=1) > 0.5, "vec": list(x)})

    return run


def pack(index: DataFrame, centres, block: int, codes=None) -> tuple[DataFrame, DataFrame]:
    """(blocks: cat, cell, ring, sub, ids, body; rings: cat, cell, ring, n, low, high, unit, subs) of ``index`` (id, cat, vec)."""
    placed = cut_lineage(index.mapInPandas(_placed(centres), f"id long, cat {index.schema['cat'].dataType.simpleString()}, cell int, far double, unit boolean, vec array<double>"))
    shares = [i / RINGS for i in range(1, RINGS)]
    edges = placed.groupBy("cat", "cell").agg(F.percentile_approx("far", shares).alias("_edges"), F.count(F.lit(1)).alias("_n"))
    edges = cut_lineage(edges.select(F.col("cat").alias("_cat"), F.col("cell").alias("_cell"), F.when(F.col("_n") > block, F.col("_edges")).otherwise(F.array().cast("array<double>")).alias("_edges")))
    ringed = placed.join(edges, F.col("cat").eqNullSafe(F.col("_cat")) & (F.col("cell") == F.col("_cell"))).withColumn(
        "ring", F.size(F.filter("_edges", lambda e: e < F.col("far")))).drop("_edges", "_cat", "_cell")
    rings = cut_lineage(ringed.groupBy("cat", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.min("unit").alias("unit"))
                        .withColumn("subs", F.ceil(F.col("n") / block).cast("int")))
    key = rings.select(F.col("cat").alias("_cat"), F.col("cell").alias("_cell"), F.col("ring").alias("_ring"), "subs")
    rows = ringed.join(key, F.col("cat").eqNullSafe(F.col("_cat")) & (F.col("cell") == F.col("_cell")) & (F.col("ring") == F.col("_ring")))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).select("id", "cat", "cell", "ring", "sub", "vec")

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        x = np.stack(f["vec"].to_list())
        body = codes.value.encode(x - centres.value[int(f["cell"].iloc[0])]) if codes else x
        one = f.iloc[:1][["cat", "cell", "ring", "sub"]].copy()
        return one.assign(ids=[f["id"].to_numpy(np.int64).tobytes()], body=[body.tobytes()])

    schema = f"cat {index.schema['cat'].dataType.simpleString()}, cell int, ring int, sub int, ids binary, body binary"
    return cut_lineage(rows.groupBy("cat", "cell", "ring", "sub").applyInPandas(packed, schema)), rings


def _in_blocks(rows: int):
    """Rows (id, cat, vec) as (cat, ids, body) with the unit vectors of at most ``rows`` of them, by ascending ids."""
    def block(cat, held: list[pd.DataFrame]) -> dict:
        f = pd.concat(held).sort_values("id")
        return {"cat": cat, "ids": f["id"].to_numpy(np.int64).tobytes(), "body": unit(np.stack(f["vec"].to_list())).tobytes()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list[pd.DataFrame]] = {}
        for f in frames:
            for cat, g in f.groupby("cat"):
                for at in range(0, len(g), rows):
                    part = g.iloc[at:at + rows]
                    if sum(map(len, held.get(cat, []))) + len(part) > rows:
                        yield pd.DataFrame([block(cat, held.pop(cat))])
                    held.setdefault(cat, []).append(part)
        if held:
            yield pd.DataFrame([block(c, h) for c, h in held.items()])

    return run


def all_scores(queries: DataFrame, index: DataFrame, k: int, query_rows: int = QUERY_ROWS, rows: int = BLOCK, held: int = HELD_BYTES) -> DataFrame:
    """(qid, id, score): the k best of a share of ``index`` (id, cat, vec) for each of ``queries`` (qid, cat, vec), scored against all of its category (not null).

    Blocks of queries meet blocks of the index in a Cartesian product, which shuffles neither and keeps ``held`` bytes of the index in a task; there a query keeps its k best over all blocks. So there are
    queries x k rows for each share of ``held`` bytes, while scores are queries x rows by nature.
    """
    spark = index.sparkSession
    kind = index.schema["cat"].dataType.simpleString()
    schema = f"cat {kind}, ids binary, body binary"
    with small_batches(spark, 4 * rows):
        q = cut_lineage(spread(queries.select(F.col("qid").alias("id"), "cat", "vec")).mapInPandas(_in_blocks(query_rows), schema))
        i = cut_lineage(spread(index.select("id", "cat", "vec")).mapInPandas(_in_blocks(rows), schema))
    size = i.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    q = q.repartition(spark.sparkContext.defaultParallelism * 4).select(F.col("cat").alias("qcat"), F.col("ids").alias("qids"), F.col("body").alias("q"))
    i = i.repartition(max(1, -(-size // held)))

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for f in frames:
            for qids, q, ids, body in zip(*(f.column(c) for c in ("qids", "q", "ids", "body"))):
                if now != (qids := qids.as_py()):  # a block of queries meets all blocks of the share before the next one comes
                    if best is not None:
                        yield pa.RecordBatch.from_pandas(best.rows())
                    now, qid = qids, np.frombuffer(qids, np.int64)
                    best = Best(qid, np.frombuffer(q.as_py(), np.float64).reshape(len(qid), -1), k)
                ids = np.frombuffer(ids.as_py(), np.int64)
                best.add(ids, np.frombuffer(body.as_py(), np.float64).reshape(len(ids), -1))
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.rows())

    with small_batches(spark, TILE_BATCH):
        tiles = q.join(i.hint("shuffle_replicate_nl"), F.col("qcat") == F.col("cat")).select("qids", "q", "ids", "body")
        return cut_lineage(tiles.mapInArrow(score, _HITS))


def _planner(centres, rings, low_rows: int, high_rows: int, kind: str):
    """Rings of each query's order that begin at its rows ``low_rows`` to ``high_rows`` and whose bound reaches its bar; ``more`` marks that others follow."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cat, g in f.groupby("cat", dropna=False):
                held = rings.value.get(None if pd.isna(cat) else cat)
                if held is None or not len(g):
                    continue
                cell, ring, low, high, units, n = held
                step = max(1, HELD_SCORES // len(cell))
                for at in range(0, len(g), step):
                    part = g.iloc[at:at + step]
                    bound = upper_bounds(np.stack(part["vec"].to_list()), centres.value, cell, low, high, units)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    bound = np.take_along_axis(bound, order, 1)
                    reach = bound >= part["bar"].fillna(-np.inf).to_numpy()[:, None] - CLOSE
                    begin = np.cumsum(n[order], axis=1) - n[order]
                    r, c = np.nonzero(reach & (begin >= low_rows) & (begin < high_rows))
                    if not len(r):
                        continue
                    chosen = order[r, c]
                    more = (reach & (begin >= high_rows)).any(axis=1)
                    rows = part.iloc[r]
                    yield pd.DataFrame({"qid": rows["qid"].to_numpy(), "cat": rows["cat"].to_numpy(), "vec": rows["vec"].to_list(), "cell": cell[chosen], "ring": ring[chosen], "more": more[r]})

    return run, f"qid long, cat {kind}, vec array<double>, cell int, ring int, more boolean"


def _tiles(asked: DataFrame, blocks: DataFrame, rings: DataFrame, centres, k: int, codes, kind: str) -> DataFrame:
    """Hits (qid, id, score) of all (query, ring) rows of ``asked``: packed query blocks meet packed index blocks."""
    on = ["cell", "ring"]
    n = asked.groupBy("cat", *on).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("chunks"))
    n = cut_lineage(n.join(rings.select(F.col("cat").alias("_cat"), *on, "subs"), on).where("cat <=> _cat").drop("_cat"))
    number = n.select(F.col("cat").alias("_cat"), *on, "subs", "chunks")
    q = asked.join(number, on).where("cat <=> _cat").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
    q = q.groupBy("cat", *on, "chunk").agg(F.collect_list(F.struct("qid", "vec")).alias("qs"), F.first("subs").alias("subs"))  # about QUERY_ROWS
    q = q.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    i = blocks.join(number, on).where("cat <=> _cat").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cat", *on, "sub", "chunk", "ids", "body")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "id": [], "score": []})]
        for qs in left["qs"]:
            qids, q = np.array([x["qid"] for x in qs], np.int64), np.stack([np.asarray(x["vec"], np.float64) for x in qs])
            for cell, ids, body in zip(right["cell"], right["ids"], right["body"]):
                ids = np.frombuffer(ids, np.int64)
                if codes:
                    s = codes.value.scores(q, centres.value[int(cell)], np.frombuffer(body, np.uint8).reshape(len(ids), -1))
                else:
                    s = q @ np.frombuffer(body, np.float64).reshape(len(ids), -1).T
                out.append(best_of(q, qids, ids, s, k))
        return pd.concat(out)

    keys = ["cat", *on, "sub", "chunk"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(score, _HITS)


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            yield f.assign(vec=list(unit(np.stack(f["vec"].to_list()))))


def nearest(queries: DataFrame, index: DataFrame, k: int, lists: int | None = None, codes: bool = False, refine: int = 8, sample: int = SAMPLE, block: int = BLOCK,
            seen: list[int] | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best of ``index`` (id, cat, vec) for each of ``queries`` (qid, cat, vec) among the rows of its category (null is one).

    ``lists``: cells, by default from the number of rows. Waves hold ``block`` rows a query at first, then eight times as many each. ``seen`` receives the number of (query, row) scores of each wave.
    """
    spark = index.sparkSession
    put = spark.sparkContext.broadcast
    kind = index.schema["cat"].dataType.simpleString()
    rows = index.count()
    x = sample_vectors(index, sample)
    if not len(x):
        return spark.createDataFrame([], _HITS + ", rank int")
    fitted = k_means(x, lists or cell_count(rows))
    centres = put(fitted)
    book = put(Codes((x - fitted[_nearest(x, fitted)])[:CODE_ROWS])) if codes else None
    blocks, rings = pack(index.select("id", "cat", "vec"), centres, block, book)
    depth = k * refine if codes else k
    n_rings = rings.count()
    state = cut_lineage(queries.select("qid", "cat", "vec").mapInPandas(_units, f"qid long, cat {kind}, vec array<double>")).withColumn("bar", F.lit(None).cast("double"))
    hits = None
    if n_rings > HELD_RINGS:
        asked = state.join(rings.select(F.col("cat").alias("_cat"), "cell", "ring"), F.col("cat").eqNullSafe(F.col("_cat"))).drop("_cat", "bar")
        hits = top_per_group(_tiles(asked, blocks, rings, centres, depth, book, kind), ["qid"], [F.col("score").desc(), F.col("id")], depth, "rank")
    else:
        held = {None if pd.isna(c) else c: tuple(g[n].to_numpy() for n in ("cell", "ring", "low", "high", "unit", "n"))
                for c, g in rings.orderBy("cell", "ring").toPandas().groupby("cat", dropna=False)}
        most = max(h[5].sum() for h in held.values())
        table, done, upto = put(held), 0, max(4 * depth, block)
        while done < most:
            run, schema = _planner(centres, table, done, upto, kind)
            asked = cut_lineage(state.mapInPandas(run, schema))
            if seen is not None:
                seen.append(int(asked.join(rings.select(F.col("cat").alias("_cat"), "cell", "ring", "n"), ["cell", "ring"]).where("cat <=> _cat").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
            new = _tiles(asked, blocks, rings, centres, depth, book, kind)
            both = new if hits is None else new.unionByName(hits.drop("rank"))
            hits = cut_lineage(top_per_group(both, ["qid"], [F.col("score").desc(), F.col("id")], depth, "rank"))
            goes_on = asked.where("more").select("qid").distinct()
            if goes_on.isEmpty():
                break
            bars = hits.where(F.col("rank") == depth).select(F.col("qid").alias("_qid"), F.col("score").alias("_bar"))
            state = cut_lineage(state.join(goes_on, "qid", "left_semi").join(bars, F.col("qid") == F.col("_qid"), "left").select("qid", "cat", "vec", F.col("_bar").alias("bar")))
            done, upto = upto, 8 * upto
    if not codes:
        return hits
    return _exact(hits, queries, index, k)


def _exact(hits: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The shortlists ranked by their vectors."""
    wanted = index.select("id", F.col("vec").alias("_v")).join(hits.select("id").distinct(), "id", "left_semi")
    pairs = hits.select("qid", "id").join(wanted, "id").join(queries.select("qid", F.col("vec").alias("_q")), "qid")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q, v = (unit(np.stack(f[c].to_list())) for c in ("_q", "_v"))
                yield pd.DataFrame({"qid": f["qid"], "id": f["id"], "score": np.round((q * v).sum(1), 12)})

    return top_per_group(pairs.mapInPandas(score, _HITS), ["qid"], [F.col("score").desc(), F.col("id")], k, "rank")
