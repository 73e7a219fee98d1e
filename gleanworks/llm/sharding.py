"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

The rows of every input partition are permuted locally; the matrix says how many of them go to each shard; after the
exchange the rows of a shard are permuted again. Row counts of partitions and sizes of shards are the margins of the matrix
and its entries follow the multivariate hypergeometric law, so the result is a uniform shuffle whose shards are exactly
as large as asked for (at most one row apart). Only counts are drawn; no row is compared with rows of other partitions.

Draws are SQL expressions: inversion where few outcomes are possible, ratio-of-uniforms rejection (Stadlober 1990) elsewhere,
at constant cost whatever the counts. All randomness comes from hashes of seed and place, so a repeated task repeats it.
The matrix is drawn in two levels, groups of partitions first, so that no task draws for more than ``GROUP`` partitions
or groups of ``GROUP`` at a time. Shards are cut into chunks of about ``CHUNK`` rows for the second permutation: chunks are ranges of
the random key, so chunk by chunk order is the order of the whole shard.

Defined cases: an empty table gives an empty result; nulls and repeated rows are rows like any other; columns named like
the added ones are replaced. Equal texts are not kept together: the law is about rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .common import let, query, read, unit

SHARDS, SEED = 40, 11
GROUP, CHUNK = 1024, 20_000
BROADCAST_ROWS = 50_000  # partitions, or chunks, whose counts may be sent to every task (320 bytes a row at most)
_TRIES = 64  # rejection accepts two of three tries: all 64 failing has probability below 1e-30
_FEW = 24


def _long(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def ln_factorial(n: Column) -> Column:
    """ln(n!) for whole n >= 0: a table below 10, Stirling's series from there."""
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(10)])

    def series(x: Column) -> Column:
        return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    return F.when(n < 10, F.get(table, n.cast("int"))).otherwise(series(n.cast("double")))


def hypergeometric(pop: Column, good: Column, draws: Column, *place: Column) -> Column:
    """Number of good ones among ``draws`` of ``pop`` without replacement; ``place`` seeds the draw."""
    def drawn(v: Column) -> Column:
        pop, good, draws, low, high = (v[k] for k in ("pop", "good", "draws", "low", "high"))
        return (F.when(high <= low, low).when(high - low <= _FEW, _invert(pop, good, draws, low, high, place))
                .otherwise(_reject(pop, good, draws, place)))

    return let(F.struct(_long(pop).alias("pop"), _long(good).alias("good"), _long(draws).alias("draws"),
                        F.greatest(_long(0), _long(draws + good - pop)).alias("low"), _long(F.least(good, draws)).alias("high")), drawn)


def _ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def _invert(pop, good, draws, low, high, place) -> Column:
    """Walk up from the least outcome, taking its probability off a uniform number."""
    first = F.exp(_ln_choose(good, low) + _ln_choose(pop - good, draws - low) - _ln_choose(pop, draws))
    start = F.struct(unit(*place).alias("left"), first.alias("p"), _long(-1).alias("out"))

    def step(a: Column, k: Column) -> Column:
        ratio = (good - k).cast("double") * (draws - k) / ((k + 1).cast("double") * (pop - good - draws + k + 1))
        return (F.when(a["out"] >= 0, a).when(a["left"] < a["p"], F.struct(a["left"].alias("left"), a["p"].alias("p"), k.alias("out")))
                .otherwise(F.struct((a["left"] - a["p"]).alias("left"), (a["p"] * ratio).alias("p"), _long(-1).alias("out"))))

    got = F.aggregate(F.sequence(low, F.least(high, low + _FEW)), start, step, lambda a: a["out"])
    return let(got, lambda x: F.when(x < 0, high).otherwise(x))


def _reject(pop, good, draws, place) -> Column:
    """Ratio of uniforms on the smaller of both halves, then mirrored back."""
    def with_sizes(v: Column) -> Column:
        g, m = v["g"], v["m"]
        share = g.cast("double") / pop
        mean, spread = m * share + 0.5, F.sqrt((pop - m).cast("double") * m * share * (1 - share) / (pop - 1) + 0.5)
        mode = F.floor((m + 1).cast("double") * (g + 1) / (pop + 2)).cast("long")

        def ln_p(x: Column) -> Column:
            return -(ln_factorial(x) + ln_factorial(g - x) + ln_factorial(m - x) + ln_factorial(pop - g - m + x))

        def with_hat(h: Column) -> Column:
            def attempt(k: Column) -> Column:
                u, w = unit(*place, k, F.lit("u")), unit(*place, k, F.lit("w"))
                x = F.floor(h["mean"] + h["width"] * (w - 0.5) / u).cast("long")
                return let(F.struct(u.alias("u"), x.alias("x")), lambda c: F.when(
                    (c["x"] >= 0) & (c["x"] <= F.least(g, m)) & (c["x"] <= h["top"]), F.when(2 * F.log(c["u"]) <= ln_p(c["x"]) - h["best"], c["x"]).otherwise(_long(-1))).otherwise(_long(-1)))

            got = F.aggregate(F.sequence(F.lit(1), F.lit(_TRIES)), _long(-1), lambda a, k: F.when(a >= 0, a).otherwise(attempt(k)))
            return let(got, lambda x: F.when(x < 0, h["mode"]).otherwise(x))

        def with_moments(s: Column) -> Column:
            return let(F.struct(s["mean"].alias("mean"), (2 * math.sqrt(2 / math.e) * s["spread"] + 3 - 2 * math.sqrt(3 / math.e)).alias("width"), s["mode"].alias("mode"),
                                ln_p(s["mode"]).alias("best"), F.floor(s["mean"] + 16 * s["spread"]).alias("top")), with_hat)

        return let(F.struct(mean.alias("mean"), spread.alias("spread"), mode.alias("mode")), with_moments)

    z = let(F.struct(F.least(good, pop - good).alias("g"), F.least(draws, pop - draws).alias("m")), with_sizes)
    mirrored = let(z, lambda x: F.when(good > pop - good, F.least(draws, pop - draws) - x).otherwise(x))
    return let(mirrored, lambda x: F.when(draws > pop - draws, good - x).otherwise(x))


def _spread(draws: Column, room: Column, *place: Column) -> Column:
    """One row of the matrix: how the ``draws`` rows of a partition fall on shards with ``room`` free slots each."""
    total = F.aggregate(room, _long(0), lambda a, x: a + x)
    start = F.struct(_long(draws).alias("draws"), total.alias("pop"), F.array().cast("array<long>").alias("out"))

    def step(a: Column, free: Column) -> Column:
        x = hypergeometric(a["pop"], free, a["draws"], *place, F.size(a["out"]))
        return let(x, lambda n: F.struct((a["draws"] - n).alias("draws"), (a["pop"] - free).alias("pop"), F.concat(a["out"], F.array(n)).alias("out")))

    return F.aggregate(room, start, step, lambda a: a["out"])


def _rows(parts: Column, room: Column, level: int, seed: int) -> Column:
    """Rows of the matrix for ``parts`` (array of part, n), one after the other, each from the room the others left."""
    start = F.struct(room.cast("array<long>").alias("room"), F.array().cast("array<struct<part:bigint,n:bigint,sent:array<bigint>>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        sent = _spread(p["n"], a["room"], F.lit(seed), F.lit(level), p["part"])
        return let(sent, lambda s: F.struct(F.zip_with(a["room"], s, lambda r, x: r - x).alias("room"),
                                            F.concat(a["out"], F.array(F.struct(p["part"].alias("part"), p["n"].alias("n"), s.alias("sent")))).alias("out")))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def communication_matrix(counts: DataFrame, sizes: Column, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(part, sent) for ``counts(part, n)``: ``sent[s]`` rows of a part go to shard s; sums are n and ``sizes``."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("part").cast("long").alias("part"), F.col("n").cast("long").alias("n")))).alias("parts")
    groups = counts.groupBy(F.expr(f"part div {group}").alias("g")).agg(listed, F.sum("n").alias("n"))
    whole = groups.select(F.col("g").alias("part"), "n").agg(listed)
    top = whole.select(F.explode(_rows(F.col("parts"), sizes, 0, seed)).alias("r")).select(F.col("r.part").alias("g"), F.col("r.sent").alias("room"))
    return (groups.join(top, "g").select(F.explode(_rows(F.col("parts"), F.col("room"), 1, seed)).alias("r"))
            .select(F.col("r.part").alias("part"), F.col("r.sent").alias("sent")))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot (gapless from 0 within the shard)."""
    mine = ["_part", "_rank", "_key", "_chunk"]
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    # Local permutation: sorted by a seeded hash of the place; the row's new place within the partition is kept with it.
    placed = src.withColumn("_at", F.monotonically_increasing_id()).withColumn("_mix", F.xxhash64(F.lit(seed), F.lit("local"), "_at"))
    placed = placed.sortWithinPartitions("_mix", "_at").withColumn("_new", F.monotonically_increasing_id())
    rows = cut_lineage(placed.select("_row", F.shiftright("_new", 33).alias("_part"), F.col("_new").bitwiseAND((1 << 33) - 1).alias("_rank"),
                                     unit(F.lit(seed), F.lit("again"), "_at").alias("_key")))
    counts = cut_lineage(rows.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    parts, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = F.array(*[_long(total // shards + (s < total % shards)) for s in range(shards)])
    matrix = communication_matrix(counts, sizes, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("sent", F.lit(1), k), _long(0), lambda a, x: a + x))
    matrix = cut_lineage(matrix.select(F.col("part").alias("_part"), ends.alias("_ends")))
    small = (lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df)
    chunks = max(1, -(-total // (shards * chunk)))
    sent = (rows.join(small(matrix, parts), "_part")
            .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
            .withColumn("_chunk", F.floor(F.col("_key") * chunks).cast("long")).drop("_ends"))
    # The second permutation, chunk by chunk; a chunk starts where the ones before it end.
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sent.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "_chunk", F.coalesce(F.sum("n").over(before), _long(0)).alias("_start")))
    within = Window.partitionBy("shard", "_chunk").orderBy("_key", "_part", "_rank")
    out = (sent.withColumn("_n", F.row_number().over(within)).join(small(starts, shards * chunks), ["shard", "_chunk"])
           .withColumn("slot", F.col("_start") + F.col("_n") - 1))
    return out.select(*[F.col("_row")[c].alias(c) for c in own], "shard", "slot").drop(*[c for c in mine if c not in own])


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = read(spark, folder, "documents").select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
