"""Cleaning as stages over one wide table: every row ends with ``dropped_at`` and ``reason``, nothing is thrown away early,
so reports, waterfalls and reconciliations are aggregations of the same DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicons as lx
from ..functions import rules as ru, text as tx
from ..ordering import top_per_group
from ..session import compute_once, cut_lineage
from . import dedup, simjoin

STAGES = ("format", "rules", "clip", "dedup")


def alive() -> Column:
    return F.col("dropped_at").isNull()


def open_stages(df: DataFrame) -> DataFrame:
    return df.withColumn("dropped_at", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))


def row_stage(df: DataFrame, name: str, reason: Column) -> DataFrame:
    """Mark living rows for which ``reason`` is not NULL."""
    hit = alive() & reason.isNotNull()
    return (compute_once(df, "_hit", F.when(hit, reason))
            .withColumn("dropped_at", F.when(F.col("_hit").isNotNull(), F.lit(name)).otherwise(F.col("dropped_at")))
            .withColumn("reason", F.coalesce("_hit", "reason")).drop("_hit"))


def format_stage(df: DataFrame) -> DataFrame:
    return row_stage(df, "format", ru.check_format(F.col("messages"), F.col("image_path")))


def rule_stage(df: DataFrame, cfg: ru.CleanConfig = ru.CleanConfig()) -> DataFrame:
    user, reply = tx.first_text(F.col("messages"), 0), tx.first_text(F.col("messages"), 1)
    return row_stage(df, "rules", ru.clean_reason(user, reply, cfg))


def consistency_stage(df: DataFrame, vectors: DataFrame, minimum: float = 0.15) -> DataFrame:
    """``vectors``: id, image_vec, text_vec. Rows without vectors pass."""
    scored = vectors.select("id", simjoin.cosine(F.col("image_vec"), F.col("text_vec")).alias("_sim"))
    return row_stage(df.join(scored, "id", "left"), "clip",
                     F.when(F.col("_sim") < minimum, F.lit(lx.REASON["unrelated"]))).drop("_sim")


def dedup_stage(df: DataFrame, hashes: DataFrame | None, near: bool = False, **kw) -> DataFrame:
    """``near=True`` replaces the literal text comparison by n-gram similarity."""
    living = df.filter(alive()).select("seq", tx.first_text(F.col("messages"), 0).alias("text"), "image_path")
    res = (dedup.dedup_near if near else dedup.dedup_exact)(living, hashes, **kw)
    gone = res.filter(~F.col("kept")).select("seq", F.lit(True).alias("_dup"))
    return row_stage(df.join(gone, "seq", "left"), "dedup", F.when(F.col("_dup"), F.lit(lx.REASON["duplicate"]))).drop("_dup")


def run_stages(samples: DataFrame, hashes: DataFrame | None = None, cfg: ru.CleanConfig = ru.CleanConfig(),
               vectors: DataFrame | None = None, extra: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """format -> rules -> consistency -> dedup. ``extra`` stages run before dedup."""
    df = rule_stage(format_stage(open_stages(samples)), cfg)
    if vectors is not None:
        df = consistency_stage(df, vectors)
    for stage in extra:
        df = stage(df)
    return dedup_stage(df, hashes)


def consistency_filter(df: DataFrame, a: str, b: str, minimum: float = 0.15) -> DataFrame:
    """Keep rows whose vectors agree; a missing vector keeps the row."""
    sim = simjoin.cosine(F.col(a), F.col(b))
    return df.withColumn("similarity", sim).filter(F.col("similarity").isNull() | (F.col("similarity") >= minimum))


def quality_gate(df: DataFrame, scores: DataFrame, minimum: float, id_col: str = "id") -> DataFrame:
    """``scores``: id, quality. Unscored rows do not pass."""
    return df.join(scores.filter(F.col("quality") >= minimum).select(id_col), id_col, "left_semi")


def rejection_report(df: DataFrame, text: Column, n_examples: int = 3, width: int = 60) -> DataFrame:
    """family, n, share of input, examples. ``df`` needs seq, dropped_at, reason."""
    fam = cut_lineage(df.select("seq", ru.reason_family(F.col("reason")).alias("family"), F.substring(text, 1, width).alias("example"),
                                F.col("dropped_at").isNotNull().alias("_gone")))  # narrow, written once: it is read three times below
    counts = fam.groupBy("family", "_gone").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ex = (top_per_group(fam.filter("_gone"), ["family"], [F.col("seq")], n_examples)
          .groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rn", "example"))).alias("_e"))
          .select("family", F.array_join(F.transform("_e", lambda e: F.coalesce(e["example"], F.lit(""))), " || ").alias("examples")))
    return counts.filter("_gone").join(ex, "family", "left").select(
        "family", "n", (F.col("n") / total.scalar()).alias("share"), "examples")


def waterfall(df: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """stage, alive: rows left after input and after every stage; one aggregation, no window."""
    gone_by = [F.count(F.when(F.col("dropped_at").isin(*stages[:i]), 1)).alias(f"g{i}") if i else F.lit(0).alias("g0")
               for i in range(len(stages) + 1)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[c for c in gone_by[1:]])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit((("input",) + tuple(stages))[i]).alias("stage"),
                              (F.col("n") - (F.col(f"g{i}") if i else F.lit(0))).alias("alive"))
                     for i in range(len(stages) + 1)])
    return one.select(F.explode(rows).alias("r"), "n").select(
        "r.step", "r.stage", "r.alive", (1 - F.col("r.alive") / F.nullif(F.col("n"), F.lit(0))).alias("lost"))


def distribution(df: DataFrame, col: str, default: str = "?") -> DataFrame:
    """value, n, share."""
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(default)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("value", "n", (F.col("n") / total.scalar()).alias("share"))


def reconcile(stages: DataFrame, labels: DataFrame, must_keep: Sequence[str]) -> DataFrame:
    """One row per check: rows, groups, must_keep with ok and bad counts.

    ``stages``: id, dropped_at; ``labels``: id, kind, expect, group. A row dropped at the wrong stage is a failure.
    """
    j = cut_lineage(labels.join(stages.select("id", F.coalesce("dropped_at", F.lit("keep")).alias("actual")), "id").select(
        "id", "kind", "expect", F.col("group").alias("grp"), "actual"))  # written once: it is read three times below
    ok = lambda c: F.count(F.when(c, 1))
    row = j.filter("expect <> 'dedup_group'").agg(ok(F.col("expect") == F.col("actual")).alias("ok"), F.count(F.lit(1)).alias("n"))
    groups = j.filter("grp is not null").groupBy("grp").agg(ok(F.col("actual") == "keep").alias("kept"))
    grp = groups.agg(ok(F.col("kept") == 1).alias("ok"), F.count(F.lit(1)).alias("n"))
    keep = j.filter(F.col("kind").isin(*must_keep)).agg(ok(F.col("actual") == "keep").alias("ok"), F.count(F.lit(1)).alias("n"))
    parts = [d.select(F.lit(name).alias("check"), "ok", (F.col("n") - F.col("ok")).alias("bad"))
             for name, d in (("rows", row), ("groups", grp), ("must_keep", keep))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
