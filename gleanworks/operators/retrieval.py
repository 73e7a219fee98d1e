"""Vector retrieval: exact and approximate top-k, hybrid results, re-ranking hook, pluggable encoders."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..ordering import top_per_group
from ..session import cut_lineage, spread
from . import vectors

QUERY_BLOCK = 512  # queries scored against a batch of the index at a time
HELD_NUMBERS = 4_000_000  # numbers in the query vectors that every task may hold
FEW_CATEGORIES = 64


_OUT = "qid long, id long, score double"


def topk_similar(queries: DataFrame, index: DataFrame, k: int, category: bool = False, min_score: float | None = None,
                 exclude_self: bool = False, block: int = QUERY_BLOCK, held: int = HELD_NUMBERS) -> DataFrame:
    """(qid, id, score, rank): cosine top-k of every query over the whole index.

    ``queries``: qid, vec[, category]; ``index``: id, vec[, category]. Queries of up to ``held`` numbers (a bounded matrix) travel to the index partitions, which are scanned
    once, ``block`` queries at a time: a task gives k rows a query, however many rows it reads. More queries meet the index in blocks (``vectors.all_scores``); in more than ``FEW_CATEGORIES``
    categories they are joined by cells (``vectors.nearest``). The rows are the same. A category filter is applied before the cut, so a query always gets its k best of that category; no category (null) meets nothing.
    """
    qcols = ["qid", "vec"] + (["category"] if category else [])
    icols = ["id", "vec"] + (["category"] if category else [])
    queries, index = queries.select(*qcols), index.select(*icols)
    if category:
        queries, index = queries.filter("category is not null"), index.filter("category is not null")
    kk = k + 1 if exclude_self else k
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    if size["n"] * size["width"] <= held:
        put = queries.sparkSession.sparkContext.broadcast(queries.toPandas())  # bounded, checked above

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [(None, put.value)] if not category else list(put.value.groupby("category"))
            best = [(c, vectors.Best(g["qid"].to_numpy()[at:at + block], vectors.unit(np.stack(g["vec"].to_list()[at:at + block])), kk)) for c, g in parts for at in range(0, len(g), block)]
            for ip in batches:
                ip = ip.sort_values("id")
                for c in {c for c, _ in best}:
                    ig = ip if c is None else ip[ip["category"] == c]
                    if len(ig):
                        ids, x = ig["id"].to_numpy(), vectors.unit(np.stack(ig["vec"].to_list()))
                        for d, b in best:
                            if d == c:
                                b.add(ids, x)
            for _, b in best:
                yield b.rows()

        local = spread(index).mapInPandas(scan, _OUT)
    else:
        cat = F.col("category") if category else F.lit(0)
        q, i = queries.select("qid", cat.alias("cat"), "vec"), index.select("id", cat.alias("cat"), "vec")
        many = category and index.select("category").distinct().limit(FEW_CATEGORIES + 1).count() > FEW_CATEGORIES
        local = vectors.nearest(q, i, kk).drop("rank") if many else vectors.all_scores(q, i, kk)
    if exclude_self:
        local = local.filter("qid <> id")
    ranked = top_per_group(local, ["qid"], [F.col("score").desc(), F.col("id")], k, "rank")
    return ranked if min_score is None else ranked.filter(F.col("score") >= min_score)


def hybrid_search(queries: DataFrame, images: DataFrame, texts: DataFrame, k: int = 3, min_score: float = 0.3) -> DataFrame:
    """Image hits and knowledge hits side by side. ``queries``: qid, image_vec, text_vec (either may be NULL)."""
    qi = queries.filter("image_vec is not null").select("qid", F.col("image_vec").alias("vec"))
    qt = queries.filter("text_vec is not null").select("qid", F.col("text_vec").alias("vec"))
    a = topk_similar(qi, images, k).withColumn("type", F.lit("product_image"))
    b = topk_similar(qt, texts, k, min_score=min_score).withColumn("type", F.lit("knowledge"))
    return a.unionByName(b)


def ann_topk(queries: DataFrame, index: DataFrame, k: int, lists: int | None = None, refine: int = 8, sample: int = vectors.SAMPLE) -> DataFrame:
    """Approximate top-k: cells by k-means, residuals as one byte for four dimensions, exact scores for the ``refine`` * k best of a query.

    A query goes on to further cells while their radius lets them reach its k-th score, so it always gets k rows if the index has them. ``lists`` follows from
    the number of rows; cells and code books are fitted on ``sample`` rows at most, every row is indexed.
    """
    q = queries.select("qid", F.lit(0).alias("cat"), "vec")
    return vectors.nearest(q, index.select("id", F.lit(0).alias("cat"), "vec"), k, lists, codes=True, refine=refine, sample=sample)


def rerank(candidates: DataFrame, picks: DataFrame, k: int = 3) -> DataFrame:
    """Move the picked candidate of a query to the front and keep k. ``picks``: qid, id; queries without a pick keep their order."""
    p = picks.select("qid", "id", F.lit(0).alias("_first"))
    j = candidates.join(p, ["qid", "id"], "left").drop("rank")
    return top_per_group(j, ["qid"], [F.coalesce("_first", F.lit(1)), F.col("score").desc(), F.col("id")], k, "rank").drop("_first")


def index_stats(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """shop, n_products, n_vectors, has_index."""
    p = products.groupBy("shop").agg(F.count(F.lit(1)).alias("n_products"))
    v = vectors.groupBy("shop").agg(F.count(F.lit(1)).alias("n_vectors"))
    return p.join(v, "shop", "left").select("shop", "n_products", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.col("n_vectors").isNotNull().alias("has_index"))


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, setup: Callable[[], object] | None = None,
             retries: int = 3, backoff_s: float = 1.0, batch: int = 64) -> DataFrame:
    """Apply an external model or encoder to batches of rows.

    ``setup`` runs once per partition and its result is passed as second argument. A failing batch is retried with growing
    pauses and then fails the task. The result is materialised, so later actions do not call the model again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                for attempt in range(retries):
                    try:
                        yield fn(part, state) if setup else fn(part)
                        break
                    except Exception:
                        if attempt == retries - 1:
                            raise
                        time.sleep(backoff_s * 2**attempt)

    return cut_lineage(df.mapInPandas(run, schema))
