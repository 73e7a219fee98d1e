"""Ranks and running sums that stay parallel when one group holds most of the rows.

A window partitioned by a hot key puts the whole key into one task. Here every group is cut
into buckets by a column that is monotone in the ordering (a hash prefix, a day, an input split);
each bucket is numbered on its own, bucket totals are prefix-summed (one row per group and bucket),
and the two are joined on (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import cut_lineage


def seeded_key(seed: int, *cols: str | Column) -> Column:
    """Repeatable random order: an md5 hex string, the same after any repartitioning."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def hash_bucket(key: str | Column, width: int = 2) -> Column:
    """Leading hex digits of a seeded key: 16**width ordered buckets."""
    return F.substring(key, 1, width)


def _offsets(df: DataFrame, keys: Sequence[str], bucket: str, totals: dict[str, Column]) -> DataFrame:
    small = df.groupBy(*keys, bucket).agg(*[c.alias(n) for n, c in totals.items()])
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return small.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("_kb"),
        *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_off_{n}") for n in totals],
    )


def _with_offsets(df: DataFrame, offs: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    cond = F.col(bucket).eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(offs, cond, "left").drop("_kb", *[f"_k{i}" for i in range(len(keys))])


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                   name: str = "rn") -> DataFrame:
    """``row_number`` over (keys, order) without a task per group. ``bucket`` must not decrease along ``order``."""
    tagged = df.withColumn("_bucket", bucket)
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = tagged.withColumn("_local", F.row_number().over(w))
    offs = _offsets(tagged, keys, "_bucket", {"n": F.count(F.lit(1))})
    out = _with_offsets(local, offs, keys, "_bucket")
    return out.withColumn(name, (F.col("_local") + F.col("_off_n")).cast("long")).drop("_local", "_off_n", "_bucket")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                 measures: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``measures`` over (keys, order), computed per bucket and shifted by bucket totals."""
    tagged = df.withColumn("_bucket", bucket)
    for n, c in measures.items():
        tagged = tagged.withColumn(f"_m_{n}", c)
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged
    for n in measures:
        local = local.withColumn(f"_run_{n}", F.sum(f"_m_{n}").over(w))
    offs = _offsets(tagged, keys, "_bucket", {n: F.sum(f"_m_{n}") for n in measures})
    out = _with_offsets(local, offs, keys, "_bucket")
    for n in measures:
        out = out.withColumn(n, F.col(f"_run_{n}") + F.col(f"_off_{n}"))
    return out.drop("_bucket", *[f"_{p}_{n}" for n in measures for p in ("m", "run", "off")])


CUT_ROWS, CUTS = 100_000, 128


def time_cuts(df: DataFrame, keys: Sequence[str], ts: str, rows: int = CUT_ROWS, name: str = "_cut") -> DataFrame:
    """Add a bucket that follows ``ts`` and cuts only groups of more than ``rows`` rows, at quantiles of their own times.

    A hot group falls into up to ``CUTS`` parts of like size, however its rows lie in time; all others are one part. Rows of one moment stay together.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    hot = cut_lineage(sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    if hot.isEmpty():
        return df.withColumn(name, F.lit(0))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    shares = [i / CUTS for i in range(1, CUTS)]
    edges = df.join(hot, same, "left_semi").groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.array_distinct(F.percentile_approx(at, shares)).alias("_edges"))
    joined = df.join(cut_lineage(edges), same, "left")
    cut = F.coalesce(F.size(F.filter("_edges", lambda e: e < at)), F.lit(0))
    return joined.withColumn(name, cut).drop("_edges", *[f"_k{i}" for i in range(len(keys))])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group. The rank filter lets Spark cut every group to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_wins(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Keep the row with the lowest ``seq`` for every key."""
    return top_per_group(df, keys, [F.col(seq).asc()], 1, "_rn").drop("_rn")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, specs: dict[str, tuple[float, str]],
                    small: int = 10000, slack: float = 3e-4) -> DataFrame:
    """Exact order statistics per group in two passes, without sorting or collecting a whole group.

    ``specs`` maps an output name to (q, kind): ``linear`` interpolates between neighbours, ``index`` takes the element
    at ``min(int(n*q), n-1)``, ``lower`` the element at ``floor((n-1)*q)``.

    Pass 1 brackets each wanted rank with ``percentile_approx`` (rank error 1/10000, bracket wider than that). Pass 2
    counts: values inside a bracket keep their identity, everything between two brackets becomes one row with a
    count. Cumulative counts over that small table name the wanted elements. Groups up to ``small`` rows keep all values.
    """
    keys = list(keys)
    src = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    gkeys = keys or ["_all"]
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    qs = sorted({q for q, _ in specs.values()})
    edges = [min(1.0, max(0.0, q + d)) for q in qs for d in (-slack, slack)]
    bounds = src.groupBy(*gkeys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", edges, 10000).alias("_e"))
    bounds = bounds.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(gkeys)], "_n", "_e")
    cond = F.lit(True)
    for i, k in enumerate(gkeys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    inside = F.col("_n") <= small
    gap = F.lit(0)
    for i in range(len(qs)):
        inside = inside | F.col("_v").between(F.col("_e")[2 * i], F.col("_e")[2 * i + 1])
        gap = gap + (F.col("_v") > F.col("_e")[2 * i + 1]).cast("int")
    table = (src.join(bounds, cond)
             .select(*gkeys, "_n", "_v", F.when(inside, F.col("_v")).alias("_in"),
                     F.when(~inside, gap).alias("_gap"))
             .groupBy(*gkeys, "_n", "_in", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_sk")))
    w = Window.partitionBy(*gkeys).orderBy("_sk").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("_cum", F.sum("_c").over(w))

    def at(idx: Column) -> Column:
        return F.max(F.when((F.col("_cum") > idx) & (F.col("_cum") - F.col("_c") <= idx), F.col("_in")))

    aggs, n = [], F.col("_n")
    for name, (q, kind) in specs.items():
        if kind == "index":
            aggs.append(at(F.least(F.floor(n * F.lit(q)), n - 1)).alias(name))
        elif kind == "lower":
            aggs.append(at(F.floor((n - 1) * F.lit(q))).alias(name))
        else:
            k = (n - 1) * F.lit(q)
            aggs += [at(F.floor(k)).alias(f"_lo_{name}"), at(F.least(F.floor(k) + 1, n - 1)).alias(f"_hi_{name}"),
                     F.max(k - F.floor(k)).alias(f"_fr_{name}")]
    out = table.groupBy(*gkeys).agg(*aggs)
    cols = list(keys)
    for name, (_, kind) in specs.items():
        lo = F.col(f"_lo_{name}") if kind == "linear" else None
        cols.append((lo + (F.col(f"_hi_{name}") - lo) * F.col(f"_fr_{name}")).alias(name) if kind == "linear"
                    else F.col(name))
    return out.select(*cols)


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, rows: int,
              chunk: int = 50_000) -> DataFrame:
    """Cut every group into chunks and repeat the last ``rows`` rows of a chunk at the head of the next one.

    Windows that look back at most ``rows`` rows can then partition by (keys, ``_chunk``) and drop the rows marked
    ``_context`` afterwards: a hot group becomes many tasks and the result is unchanged. Adds ``_rn`` (1-based).
    """
    ranked = rank_in_groups(df, keys, order, bucket, "_rn")
    own = F.floor((F.col("_rn") - 1) / chunk)
    pos = F.pmod(F.col("_rn") - 1, F.lit(chunk))
    spots = F.array_compact(F.array(F.struct(own.alias("_chunk"), F.lit(False).alias("_context")),
                                    F.when(pos >= chunk - rows, F.struct((own + 1).alias("_chunk"), F.lit(True).alias("_context")))))
    return ranked.withColumn("_spot", F.explode(spots)).select("*", "_spot._chunk", "_spot._context").drop("_spot")
