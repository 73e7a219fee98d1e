"""Iterative resolution over edge lists: greedy keep in input order, and connected components.

Every round is a fixed number of joins and aggregations; lineage is cut in reliable storage between rounds, so a lost
executor replays one round and not the whole loop.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


LOCAL_EDGES = 1_000_000  # edges that one task scans at a time


def greedy_dropped(edges: DataFrame, local_edges: int = LOCAL_EDGES, rounds: int = 6) -> DataFrame:
    """Nodes dropped by "drop a row if an earlier kept row is its neighbour".

    ``edges`` has columns a < b in input order. A node that is no edge's later end is kept for sure, so its later
    neighbours are dropped; both leave the graph and the rule is applied again. Long chains would need a round for every two links, so after ``rounds``
    rounds what is left falls apart into components. Those of at most ``local_edges`` edges are scanned in input order by one task each. Larger ones are cut into ranges of
    later ends with about that many edges: the ranges are decided in order, those of all components side by side, one pass each, with the decisions about earlier rows joined in.
    Neither number changes the result.
    """
    edges = cut_lineage(edges.select("a", "b").distinct())
    dropped: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        later = edges.select(F.col("b").alias("a")).distinct()
        out = edges.join(later, "a", "left_anti").select(F.col("b").alias("x")).distinct()
        out = cut_lineage(out)
        dropped.append(out)
        edges = cut_lineage(edges.join(out, edges.a == out.x, "left_anti").join(out, edges.b == out.x, "left_anti"))
    if not edges.isEmpty():
        dropped += _by_ranges(edges, local_edges)
    if not dropped:
        return edges.select(F.col("a").alias("node")).limit(0)
    return reduce(DataFrame.unionByName, dropped).select(F.col("x").alias("node"))


def _by_ranges(edges: DataFrame, local_edges: int) -> list[DataFrame]:
    part = components(edges).select(F.col("node").alias("a"), "component")
    parted = cut_lineage(edges.join(part, "a"))
    sizes = cut_lineage(parted.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    most = sizes.agg(F.max("n")).first()[0]
    local_edges = max(1, local_edges)
    passes = -(-most // local_edges)
    if passes > 1:  # bounds between the ranges of a component's later ends; a small component has one range
        shares = [i / passes for i in range(1, passes)]
        cuts = parted.join(sizes.where(F.col("n") > local_edges).select("component"), "component", "left_semi").groupBy("component").agg(
            F.array_distinct(F.percentile_approx("b", shares, 100 * passes)).alias("cuts"))
        placed = parted.join(cuts, "component", "left")
        below = lambda c: F.coalesce(F.size(F.filter("cuts", lambda e: e < F.col(c))), F.lit(0))
        parted = cut_lineage(placed.select("component", "a", "b", below("a").alias("ra"), below("b").alias("rb")))
    else:
        parted = parted.withColumns({"ra": F.lit(0), "rb": F.lit(0)})
    dropped: list[DataFrame] = []
    for k in range(passes):
        here = parted.where(F.col("rb") == k)
        inside = here.where(F.col("ra") == k)
        if dropped:  # what earlier kept rows drop
            gone = reduce(DataFrame.unionByName, dropped)
            out = cut_lineage(here.where(F.col("ra") < k).join(gone, F.col("a") == F.col("x"), "left_anti").select(F.col("b").alias("x")).distinct())
            dropped.append(out)
            inside = inside.join(out, F.col("a") == F.col("x"), "left_anti").join(out, F.col("b") == F.col("x"), "left_anti")
        dropped.append(cut_lineage(inside.select("component", "a", "b").groupBy("component").applyInPandas(lambda pdf: _scan(pdf), "x long")))
    return dropped


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rule applied to one component in input order."""
    pdf = pdf.sort_values(["a", "b"])
    gone: set[int] = set()
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        if a not in gone:
            gone.add(b)
    return pd.DataFrame({"x": sorted(gone)}, dtype="int64")


def greedy_keep(nodes: DataFrame, edges: DataFrame, node: str = "seq") -> DataFrame:
    """Rows of ``nodes`` that survive the sequential rule."""
    gone = greedy_dropped(edges)
    return nodes.join(gone, nodes[node] == gone["node"], "left_anti")


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node id as component label, for all nodes on an edge.

    Alternates the published large-star and small-star steps; the number of rounds grows with the logarithm of the
    component size, and star centres are handled by a partial minimum and a joinable (skew-splittable) edge list.
    """
    cur = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .filter("u <> v").distinct())
    before = _fingerprint(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small_low.select("u", F.col("m").alias("v")))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
        cur = cut_lineage(small)
        after = _fingerprint(cur)
        if after == before:
            break
        before = after
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
