"""Preference pairs: mining, merging, checking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicons as lx
from ..functions import rewards as rw, rules as ru, text as tx
from ..ordering import exact_quantiles, seeded_key
from .packing import numbered_pool, seeded_pick


def union_pairs(parts: Mapping[str, DataFrame], require_images: bool = False, image_root: str | None = None) -> DataFrame:
    """Union pair tables of slightly different shape. ``parts`` maps a source name to a table; missing columns are NULL."""
    cols = {"id": "string", "prompt": "string", "query": "string", "chosen": "string", "rejected": "string",
            "images": "array<string>", "image": "string", "source": "string", "error_type": "string"}
    aligned = []
    for name, df in parts.items():
        have = set(df.columns)
        aligned.append(df.select(F.lit(name).alias("file"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in cols.items()]))
    u = reduce(DataFrame.unionByName, aligned)
    one = F.when(F.coalesce(F.col("image"), F.lit("")) != "", F.array("image")).otherwise(F.array().cast("array<string>"))
    images = F.when(F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0, F.col("images")).otherwise(one)
    if image_root:
        images = F.transform(images, lambda i: F.when(i.startswith("/"), i).otherwise(F.concat(F.lit(image_root.rstrip("/") + "/"), i)))
    u = u.filter(ru.pair_filter(F.col("chosen"), F.col("rejected"))).withColumn("images", images)
    if require_images:
        u = u.filter(F.size("images") > 0)
    prompt = tx.strip(F.coalesce(F.nullif("prompt", F.lit("")), F.nullif("query", F.lit("")), F.lit("")))
    return u.select("file", "id", prompt.alias("prompt"), tx.strip(F.col("chosen")).alias("chosen"), tx.strip(F.col("rejected")).alias("rejected"),
                    "images", F.coalesce("source", "file").alias("source"), F.coalesce("error_type", F.lit("unknown")).alias("error_type"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("file", "source").agg(F.count(F.lit(1)).alias("n"))


def mix_sources(pairs: DataFrame, ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Keep a seeded share of every source; sources without a ratio are kept whole. Selection is per row, without a sort."""
    u = F.conv(F.substring(seeded_key(seed, "source", "id"), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    keep = reduce(lambda acc, kv: F.when(F.col("source") == kv[0], u < kv[1]).otherwise(acc), ratios.items(), F.lit(True))
    return pairs.filter(keep)


def pairs_from_bad_cases(bad: DataFrame) -> DataFrame:
    """rejected = the model's answer, chosen = the reference; incomplete cases are left out."""
    ok = (F.coalesce("model_answer", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != "")
    return bad.filter(ok).select("id", "images", F.coalesce("query", F.lit("")).alias("prompt"), F.col("reference").alias("chosen"),
                                 F.col("model_answer").alias("rejected"), F.lit("bad_case").alias("source"), "error_type")


def incomplete_bad_cases(bad: DataFrame) -> DataFrame:
    ok = (F.coalesce("model_answer", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != "")
    return bad.agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(~ok, 1)).alias("n_skipped"))


def contrastive_pairs(df: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """Same question and answer, once with its own image and once with an image of another type.

    ``df``: seq, id, image_type, image_path, query, answer. Images of a type are numbered, the other type and the number
    are derived from a hash of the row, and one equi-join fetches the image. The same hash spreads rows over all images of a
    type, so a large type does not become a hot key.
    """
    usable = df.filter("image_path is not null and image_path <> ''")
    pool, sizes = numbered_pool(usable, ["image_type"], "image_path", seed)
    w = Window.orderBy("image_type")  # one row per image type
    types = sizes.withColumn("t", F.row_number().over(w) - 1)
    n_types = sizes.agg(F.count(F.lit(1))).scalar()
    rows = usable.filter("query is not null and answer is not null")
    rows = rows.join(types.select("image_type", F.col("t").alias("own")), "image_type").filter(n_types >= 2)
    step = 1 + F.pmod(seeded_pick(seed + 1, "id"), F.greatest(n_types - 1, F.lit(1)))
    rows = rows.withColumn("t", F.pmod(F.col("own") + step, n_types))
    target = types.select("t", F.col("image_type").alias("other_type"), "pool_size")
    rows = rows.join(target, "t").withColumn("idx", F.pmod(seeded_pick(seed + 2, "id"), F.col("pool_size")))
    other = pool.select(F.col("image_type").alias("other_type"), "idx", F.col("image_path").alias("other_image"))
    out = rows.join(other, ["other_type", "idx"]).select(
        "seq", F.concat(F.lit("contrast_"), F.col("id").cast("string")).alias("id"), F.col("query").alias("prompt"),
        F.col("answer").alias("chosen"), F.col("answer").alias("rejected"), F.array("image_path").alias("chosen_images"),
        F.array("other_image").alias("rejected_images"), "image_type", "other_type", F.lit("contrastive").alias("source"))
    return out if n is None else out.orderBy("seq").limit(n)


def pair_issues(pairs: DataFrame, listing: DataFrame | None = None, boilerplate: Sequence[str] = lx.BOILERPLATE) -> DataFrame:
    """issue, n for the common ways a pair set is dirty. ``listing``: path of existing images; NULL skips that check."""
    head = F.substring("rejected", 1, 20)
    flags = {
        "no_image": F.size(F.coalesce("images", F.array().cast("array<string>"))) == 0,
        "empty_prompt": F.coalesce("prompt", F.lit("")) == "",
        "short_chosen": F.length("chosen") * 3 < F.length("rejected"),
        "boilerplate": tx.contains_any(head, boilerplate) & (F.length("rejected") < 40),
    }
    counts = pairs.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in flags.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(lx.PAIR_ISSUES[k]).alias("issue"), F.col(k).alias("n")) for k in flags])).alias("x")).select("x.*")
    if listing is not None:
        refs = pairs.select("id", F.explode("images").alias("path"))
        gone = refs.join(listing.select("path").distinct(), "path", "left_anti").agg(F.countDistinct("id").alias("n"))
        out = out.unionByName(gone.select(F.lit(lx.PAIR_ISSUES["missing_image"]).alias("issue"), "n"))
    return out


def pair_stats(pairs: DataFrame) -> DataFrame:
    """side, p50, p90, p99 (by index), max of the three lengths, with the share of longer chosen answers on every row."""
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.length(c).alias("len")) for c in ("prompt", "chosen", "rejected")])).alias("x")).select("x.*")
    q = exact_quantiles(long, ["side"], "len", {"p50": (0.5, "index"), "p90": (0.9, "index"), "p99": (0.99, "index")})
    top = long.groupBy("side").agg(F.max("len").alias("max"))
    ratio = pairs.agg(F.avg(F.when(F.length("chosen") > F.length("rejected"), 1.0).otherwise(0.0))).scalar()
    return q.join(top, "side").withColumn("chosen_longer", ratio).withColumn("imbalanced", (F.col("chosen_longer") > 0.75) | (F.col("chosen_longer") < 0.25))


def drop_uneven(pairs: DataFrame, limit: float = 4.0) -> DataFrame:
    return pairs.filter(ru.pair_length_ratio_ok(F.col("chosen"), F.col("rejected"), limit))


def dpo_metrics(logps: DataFrame, keys: Sequence[str] = (), beta: float = 0.1, smoothing: float = 0.0) -> DataFrame:
    t = logps.withColumn("_t", rw.dpo_terms(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), beta, smoothing))
    return t.groupBy(*keys).agg(F.avg("_t.loss").alias("loss"), F.avg("_t.hit").alias("accuracy"), F.avg("_t.reward_chosen").alias("rewards_chosen"),
                                F.avg("_t.reward_rejected").alias("rewards_rejected"), F.avg("_t.margin").alias("reward_margin"))


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(r - mean) / std inside the prompt group, 0 for a constant group. Statistics are aggregated and joined back: a prompt
    with very many completions is combined before the shuffle instead of sorted in one task."""
    st = df.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    adv = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) > 1e-12, (F.col(reward) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return df.join(st, group).withColumn("advantage", adv).drop("_m", "_s")


def score_rewards(df: DataFrame) -> DataFrame:
    """Add ``reward`` (struct of parts). ``df``: completion, expected_tool, expected_slots, allowed_tools, visible_objects,
    should_refuse, target_length."""
    from ..functions.jsonx import extract_json
    c = F.col
    parsed = df.withColumn("_p", extract_json(c("completion"))).withColumn("_c", rw.visual_claims(c("completion"), c("visible_objects")))
    return parsed.withColumn("reward", rw.compute_reward(c("completion"), c("_p"), c("_c"), c("expected_tool"), c("expected_slots"), c("allowed_tools"),
                                                         c("should_refuse"), c("target_length"))).drop("_p", "_c")
