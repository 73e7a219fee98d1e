"""Judging model answers: one flattened record table feeds every summary, and failure has one definition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicons as lx
from ..functions import rules as ru, text as tx
from ..session import compute_once, cut_lineage
from ..ordering import exact_quantiles, hash_bucket, rank_in_groups, seeded_key, top_per_group



def attach_reference(answers: DataFrame, eval_set: DataFrame, cols: Sequence[str], key: str = "id") -> DataFrame:
    return answers.join(eval_set.select(key, *cols), key, "left")


def judge_answers(samples_with_answers: DataFrame, refusals: Sequence[str] = lx.REFUSAL_MARKERS,
                  promises: Sequence[str] = lx.OVER_PROMISES, labels: Sequence[str] = ()) -> DataFrame:
    """Add ``rule``: struct<passed, score, checks>."""
    c = F.col
    scanned = compute_once(samples_with_answers, "_scan", ru.scan_answer(c("model_answer"), c("must_contain"), c("must_not_contain"), refusals, promises))
    return scanned.withColumn("rule", ru.rule_verdict(c("_scan"), c("model_answer"), c("must_contain"), c("should_refuse"), c("expected_intent"), labels)).drop("_scan")


def flatten(records: DataFrame) -> DataFrame:
    """The columns all summaries work on. ``records`` follows EVAL_RECORD."""
    j = ru.judge_number(F.col("judge"))
    err = ru.has_error(F.col("error"))
    return records.select(
        "tag", "id", F.coalesce(F.nullif("difficulty", F.lit("")), F.lit(lx.UNKNOWN)).alias("tier"),
        F.coalesce(F.nullif("intent", F.lit("")), F.lit(lx.UNKNOWN)).alias("intent"), err.alias("is_error"),
        F.col("rule.passed").alias("passed"), F.col("rule.score").alias("score"), j.alias("judge"), "latency_ms",
        ru.is_failure(F.col("error"), F.col("rule.passed"), j).alias("failed"))


def summary(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, n_err, rule_pass, rule_score, judge, n_judged, n_fail, p50, p95. Rates are NULL without a denominator."""
    ok = ~F.col("is_error")
    n_ok = F.count(F.when(ok, 1))
    base = flat.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~ok, 1)).alias("n_err"),
        (F.count(F.when(ok & F.col("passed"), 1)) / F.nullif(n_ok, F.lit(0))).alias("rule_pass"),
        F.avg(F.when(ok, F.col("score"))).alias("rule_score"), F.avg(F.when(ok, F.col("judge"))).alias("judge"),
        F.count(F.when(ok, F.col("judge"))).alias("n_judged"), F.count(F.when(F.col("failed"), 1)).alias("n_fail"))
    q = exact_quantiles(flat.filter(ok), keys, "latency_ms", {"p50": (0.5, "linear"), "p95": (0.95, "linear")})
    return base.join(q, list(keys), "left")


def by_level(flat: DataFrame) -> DataFrame:
    """tag, level, grp + summary for whole runs, tiers and intents: every record is read once and counted at three levels."""
    lv = F.array(*[F.struct(F.lit(n).alias("level"), g.alias("grp")) for n, g in
                   (("run", F.lit("")), ("tier", F.col("tier")), ("intent", F.col("intent")))])
    return summary(flat.withColumn("_l", F.explode(lv)).select("*", "_l.level", "_l.grp").drop("_l"), ["tag", "level", "grp"])


def long_metrics(summ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, metric, value. A metric whose denominator is zero is NULL, not 0."""
    num = lambda c: F.col(c).cast("double")
    guard = lambda c, n: F.when(F.col(n) > 0, F.col(c))
    m = [("n", num("n")), ("rule_pass", guard("rule_pass", "n")), ("rule_score", guard("rule_score", "n")),
         ("judge", guard("judge", "n_judged")), ("n_judged", num("n_judged")), ("p95", guard("p95", "n"))]
    return summ.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in m])).alias("x")
                       ).select(*keys, "x.metric", "x.value")


def compare_runs(flat: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row per metric, one column per run tag."""
    return long_metrics(summary(flat, ["tag"]), ["tag"]).groupBy("metric").pivot("tag", list(tags)).agg(F.first("value"))


def compare_baseline(flat: DataFrame, current: str, base: str) -> DataFrame:
    """tier, pass_rate, base_rate, delta, has_base. A tier without baseline has NULL, not a zero rate."""
    s = summary(flat.filter(F.col("tag").isin(current, base)), ["tag", "tier"])
    cur = s.filter(F.col("tag") == current).select("tier", "n", F.col("rule_pass").alias("pass_rate"))
    old = s.filter(F.col("tag") == base).select("tier", F.col("rule_pass").alias("base_rate"))
    return cur.join(old, "tier", "left").select("tier", "n", "pass_rate", "base_rate",
                                               (F.col("pass_rate") - F.col("base_rate")).alias("delta"),
                                               F.col("base_rate").isNotNull().alias("has_base"))


def weakest_group(levels: DataFrame) -> DataFrame:
    """tag, level, weakest, low, spread, verdict from ``by_level``; ties and saturated sets name no weak spot."""
    g = levels.filter("level <> 'run'").groupBy("tag", "level").agg(
        F.min_by("grp", F.struct("rule_pass", "grp")).alias("weakest"), F.min("rule_pass").alias("low"),
        (F.max("rule_pass") - F.min("rule_pass")).alias("spread"))
    flat_all = F.col("spread") < 0.02
    verdict = (F.when((F.col("level") == "tier") & flat_all & (F.col("low") > 0.98), F.lit("no_weak"))
               .when((F.col("level") == "intent") & flat_all, F.when(F.col("low") > 0.98, F.lit("all_high")).otherwise(F.lit("tied")))
               .otherwise(F.lit("weak")))
    return g.withColumn("verdict", verdict)


def unnest_checks(records: DataFrame) -> DataFrame:
    """id, check, passed, score, detail."""
    return records.select("id", F.explode("rule.checks").alias("check", "r")).select("id", "check", "r.passed", "r.score", "r.detail")


def failed_checks(records: DataFrame, n_examples: int = 2) -> DataFrame:
    """check, n, share of all records, examples (lowest ids)."""
    bad = unnest_checks(records).filter(~F.col("passed"))
    total = records.agg(F.count(F.lit(1)))
    counts = bad.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    ex = top_per_group(bad, ["check"], [F.col("id")], n_examples).groupBy("check").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return counts.join(ex, "check").select("check", "n", (F.col("n") / total.scalar()).alias("share"), "examples")


def record_columns() -> dict[str, Column]:
    """What ``rules.error_types`` needs, taken from an EVAL_RECORD table."""
    return {"difficulty": F.col("difficulty"), "checks": F.col("rule.checks"), "error": F.col("error"),
            "model_answer": F.col("model_answer"), "judge_accuracy": F.try_element_at("judge", F.lit("accuracy"))}


def failures(records: DataFrame, groups: Mapping[str, Sequence[str]] = lx.KEYWORD_GROUPS, rules=ru.ERROR_RULES) -> DataFrame:
    """Failed records with error_types (by the ordered ``rules``), label and semantic group. Errors in the run count as failures too."""
    j = ru.judge_number(F.col("judge"))
    bad = records.filter(ru.is_failure(F.col("error"), F.col("rule.passed"), j))
    typed = bad.withColumn("error_types", ru.error_types(record_columns(), rules))
    both = F.concat(F.coalesce("query", F.lit("")), F.coalesce("model_answer", F.lit("")))
    return (typed.withColumn("label", ru.failure_label(F.col("error_types"), F.col("error"), F.col("rule.score")))
            .withColumn("semantic_group", ru.semantic_group(both, groups)))


def _most(counts: DataFrame, name: str, top: int | None) -> DataFrame:
    return counts if top is None else counts.orderBy(F.col("n").desc(), name).limit(top)


def error_type_counts(fails: DataFrame, top: int | None = None, n_examples: int = 3) -> DataFrame:
    """Multi-label counts: a record may appear under several types."""
    total = fails.agg(F.count(F.lit(1)))
    long = fails.select("id", F.explode("error_types").alias("error_type"))
    counts = long.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    ex = top_per_group(long, ["error_type"], [F.col("id")], n_examples).groupBy("error_type").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return (_most(counts, "error_type", top).join(ex, "error_type")
            .select("error_type", "n", (F.col("n") / total.scalar()).alias("share"), "examples"))


def semantic_group_counts(fails: DataFrame, top: int | None = None) -> DataFrame:
    total = fails.agg(F.count(F.lit(1)))
    return (_most(fails.groupBy("semantic_group").agg(F.count(F.lit(1)).alias("n")), "semantic_group", top)
            .select("semantic_group", "n", (F.col("n") / total.scalar()).alias("share")))


def tier_intent_crosstab(fails: DataFrame, intents: Sequence[str]) -> DataFrame:
    """All four tiers x the named intents, 0-filled."""
    spark = fails.sparkSession
    tiers = spark.createDataFrame([(t,) for t in lx.TIERS], "difficulty string")
    p = fails.groupBy("difficulty").pivot("intent", list(intents)).agg(F.count(F.lit(1)))
    return F.broadcast(tiers).join(p, "difficulty", "left").fillna(0)


def failure_modes(fails: DataFrame) -> DataFrame:
    """One label per failure: label, n, share, sample query (lowest id)."""
    total = fails.agg(F.count(F.lit(1)))
    g = fails.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.substring("query", 1, 32), "id").alias("sample"))
    return g.select("label", "n", (F.col("n") / total.scalar()).alias("share"), F.replace("sample", F.lit("|"), F.lit("／")).alias("sample"))


def bad_cases(fails: DataFrame) -> DataFrame:
    types = F.when(F.size("error_types") > 0, F.array_join("error_types", ",")).otherwise(F.lit("unknown"))
    return fails.select("id", "query", "images", "model_answer", "reference", types.alias("error_type"), "semantic_group",
                        "difficulty", "intent")


def ablation_deltas(summ: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per stage in the given order: pass, judge and the change against the stage before."""
    pos = F.array_position(tx.lit_array(order), F.col("tag")).cast("int")
    w = Window.orderBy("step")  # one row per named stage
    s = summ.filter(F.col("tag").isin(*order)).withColumn("step", pos)
    return s.select("step", "tag", "rule_pass", "judge", (F.col("rule_pass") - F.lag("rule_pass").over(w)).alias("d_pass"),
                    (F.col("judge") - F.lag("judge").over(w)).alias("d_judge"))


def next_actions(levels: DataFrame, modes: DataFrame, first: str, last: str) -> DataFrame:
    """Hint rows (hint, subject, value) that follow from the numbers: weakest tier, largest failure class, change of the run."""
    weak = weakest_group(levels).filter((F.col("tag") == first) & (F.col("level") == "tier")).select(
        F.when(F.col("verdict") == "no_weak", F.lit("harder_set")).otherwise(F.lit("add_data")).alias("hint"),
        F.col("weakest").alias("subject"), F.col("low").alias("value"))
    top = modes.orderBy(F.col("n").desc(), "label").limit(1).select(F.lit("top_failure").alias("hint"), F.col("label").alias("subject"),
                                                                    F.col("share").alias("value"))
    runs = levels.filter("level = 'run'")
    d = runs.agg((F.max(F.when(F.col("tag") == last, F.col("rule_pass"))) - F.max(F.when(F.col("tag") == first, F.col("rule_pass")))).alias("d"))
    change = d.select(F.when(F.abs("d") <= 0.005, F.lit("flat")).when(F.col("d") > 0, F.lit("improved")).otherwise(F.lit("regressed")).alias("hint"),
                      F.lit(last).alias("subject"), F.col("d").alias("value"))
    return weak.unionByName(top).unionByName(change)


def eval_card(eval_set: DataFrame, leak: DataFrame) -> DataFrame:
    """dimension, value, n, share for tier, intent and image type, plus the leakage status with what was checked."""
    dims = F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("value"))
                     for c in ("difficulty", "intent", "image_type")])
    counts = eval_set.select(F.explode(dims).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))
    total = eval_set.agg(F.count(F.lit(1)))
    rows = counts.select("dimension", "value", "n", (F.col("n") / total.scalar()).alias("share"))
    status = F.when(F.col("n_eval_checked") == 0, F.lit("not_checked")).when(F.col("n_leak_eval_images") > 0, F.lit("leaking")).otherwise(F.lit("clean"))
    lk = leak.select(F.lit("leakage").alias("dimension"), status.alias("value"), F.col("n_eval_checked").alias("n"), F.col("leak_rate").alias("share"))
    return rows.unionByName(lk)


# ---- building and checking an evaluation set ----

def _words(ws: Sequence[str]) -> Column:
    return tx.lit_array(ws)


def eval_templates(spark) -> DataFrame:
    """tier, template, key, query, must_contain, must_not_contain, should_refuse; a few dozen rows."""
    rows = []
    for key, ts in lx.L1_TEMPLATES.items():
        rows += [("L1", f"{key}_{i}", key, len(lx.L1_TEMPLATES), len(ts), q, list(m), list(f), False) for i, (q, m, f) in enumerate(ts)]
    for key, ts in lx.L2_TEMPLATES.items():
        rows += [("L2", f"{key}_{i}", key, len(lx.L2_TEMPLATES), len(ts), q, list(m), list(f), False) for i, (q, m, f) in enumerate(ts)]
    rows += [("L3", f"multi_{i}", None, 1, len(lx.L3_TEMPLATES), q, list(m), list(f), False) for i, (q, m, f) in enumerate(lx.L3_TEMPLATES)]
    rows += [("L4", f"hard_{i}", None, 1, len(lx.L4_TEMPLATES), q, list(lx.L4_REQUIRED) if r else [], [], r)
             for i, (q, r) in enumerate(lx.L4_TEMPLATES)]
    return spark.createDataFrame(rows, "tier string, template string, match string, n_keys int, n_templates int, query string, "
                                       "must_contain array<string>, must_not_contain array<string>, should_refuse boolean")


def tier_quotas(n_target: int) -> dict[str, int]:
    return {"L1": int(n_target * 0.30), "L2": int(n_target * 0.35), "L3": int(n_target * 0.25), "L4": n_target - int(n_target * 0.90)}


def build_eval_set(pool: DataFrame, templates: DataFrame, n_target: int = 320, seed: int = 42, version: str = "v1",
                   empty_ok: bool = False) -> DataFrame:
    """Draw samples for every template in seeded order. ``pool``: id, image_type, intent, images.

    L1 templates draw from their image type, L2 from their intent, L3 from multi-image samples if there are any, L4 from
    everything. The quota per template is bounded by ``n_target``, so the rank filter prunes before the shuffle.
    """
    quotas = tier_quotas(n_target)
    cap = n_target + 1
    q = F.create_map(*[x for t, v in quotas.items() for x in (F.lit(t), F.lit(v))])
    tmpl = F.broadcast(templates.withColumn("per_t", F.greatest(F.lit(1), F.floor(F.floor(q[F.col("tier")] / F.col("n_keys")) / F.col("n_templates")))))
    p = pool.select(F.col("id").alias("src_id"), "image_type", "intent", "images")
    multi = p.filter(F.size("images") >= 2)
    l3 = multi if not multi.isEmpty() else p.filter(F.size("images") >= 1)
    parts = [
        p.join(tmpl.filter("tier = 'L1'"), F.col("image_type") == F.col("match")),
        p.join(tmpl.filter("tier = 'L2'"), F.col("intent") == F.col("match")),
        l3.withColumn("tier", F.lit("L3")).join(tmpl.filter("tier = 'L3'"), "tier"),
        p.withColumn("tier", F.lit("L4")).join(tmpl.filter("tier = 'L4'"), "tier"),
    ]
    cols = ["src_id", "image_type", "intent", "images", "tier", "template", "query", "must_contain", "must_not_contain",
            "should_refuse", "per_t"]
    drawn = None
    for d in parts:
        d = d.select(*cols).withColumn("_h", seeded_key(seed, "template", "src_id"))
        d = top_per_group(d, ["tier", "template"], [F.col("_h"), F.col("src_id")], cap, "draw").filter("draw <= per_t")
        drawn = d if drawn is None else drawn.unionByName(d)
    w = Window.orderBy("tier", "template", "draw")  # at most n_target rows
    out = drawn.withColumn("_n", F.row_number().over(w) - 1)
    out = out.select(F.format_string(f"{version}_%s_%04d", "tier", "_n").alias("id"), "src_id", "query", "images",
                     F.col("tier").alias("difficulty"),
                     F.when(F.col("tier") != "L4", F.col("intent")).when(F.col("query").contains("好看"), F.lit("presale_general"))
                     .otherwise(F.lit("return_refund")).alias("intent"),
                     F.when(F.col("tier") == "L3", F.lit("user_compare")).otherwise(F.col("image_type")).alias("image_type"),
                     "template", "draw", "must_contain", "must_not_contain", "should_refuse")
    if not empty_ok:
        missing = empty_tiers(out).collect()
        if missing:
            raise ValueError(f"no sample could be built for tiers {[r.tier for r in missing]}")
    return out


def empty_tiers(df: DataFrame, col: str = "difficulty") -> DataFrame:
    spark = df.sparkSession
    want = F.broadcast(spark.createDataFrame([(t,) for t in lx.TIERS], "tier string"))
    return want.join(df.groupBy(F.col(col).alias("tier")).agg(F.count(F.lit(1)).alias("n")), "tier", "left").filter(
        F.coalesce("n", F.lit(0)) == 0).select("tier")


def lint_templates(df: DataFrame, markers: Sequence[str] = lx.META_MARKERS) -> DataFrame:
    """id, problem: contradictory, descriptive or blank keywords and queries that are too short."""
    must = F.coalesce("must_contain", F.array().cast("array<string>"))
    forbid = F.coalesce("must_not_contain", F.array().cast("array<string>"))
    rules = [("short_query", F.length(F.coalesce("query", F.lit(""))) < 3),
             ("meta_word", F.exists(must, lambda k: tx.contains_any(k, markers))),
             ("blank_word", F.exists(must, lambda k: F.length(tx.strip(k)) == 0)),
             ("contradiction", F.arrays_overlap(must, forbid))]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return df.select("id", F.explode(found).alias("problem"))


def lint_texts(reports: DataFrame, words: Sequence[str] = lx.FUZZY_WORDS, id_col: str = "id", text: str = "text") -> DataFrame:
    """id, line, word for vague wording in report texts."""
    lines = reports.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line_text"))
    hit = F.array_compact(F.array(*[F.when(F.col("line_text").contains(w), F.lit(w)) for w in words]))
    return lines.select(id_col, (F.col("pos") + 1).alias("line"), F.explode(hit).alias("word"))


def oracle_answer(must: Column, forbid: Column, refuse: Column, refusal_text: str, lead: str = "") -> Column:
    """An answer made of everything the rules ask for; it must pass, otherwise the evaluation set is wrong."""
    body = F.concat(F.lit(lead), F.array_join(F.array_except(must, forbid), "、"))
    return F.when(refuse, F.lit(refusal_text)).otherwise(body)


def oracle_failures(eval_set: DataFrame, refusal_text: str, **lex) -> DataFrame:
    """Samples whose constructed answer fails."""
    ans = oracle_answer(F.col("must_contain"), F.col("must_not_contain"), F.col("should_refuse"), refusal_text)
    answered = compute_once(eval_set.drop("model_answer"), "model_answer", ans)
    # looking for every word takes words x length; the verdict needs one, so passing rows leave before the rest is judged in full
    one = F.when(F.exists("must_contain", lambda k: F.contains("model_answer", k)), F.array(F.lit(""))).otherwise(F.col("must_contain"))
    failing = judge_answers(answered.withColumns({"_all": F.col("must_contain"), "must_contain": one}), **lex).filter(~F.col("rule.passed"))
    return judge_answers(failing.select(*[F.col("_all").alias(c) if c == "must_contain" else F.col(c) for c in answered.columns]), **lex)


def calibration_sheet(eval_set: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Random n rows with what an annotator needs to see."""
    shown = F.coalesce(F.nullif("reference", F.lit("")), F.concat(F.lit("+"), F.array_join("must_contain", ","), F.lit(" -"), F.array_join("must_not_contain", ",")))
    return (eval_set.orderBy(seeded_key(seed, "id"), "id").limit(n)
            .select("id", "difficulty", "query", F.array_join("images", ", ").alias("images"), shown.alias("expected"), "should_refuse"))


# ---- suites, agreement, judges ----

def suite_accuracy(df: DataFrame, suites: Mapping[str, tuple[str, int]] = lx.SUITES, scorers=tx.SCORERS) -> DataFrame:
    """suite, n, official_n, accuracy. ``df``: suite, answer, golds; ``suites``: (kind, official size) by name; ``scorers``: scoring expression by kind."""
    score = F.coalesce(*[F.when(F.col("suite") == s, tx.score_answer(F.col("answer"), F.col("golds"), kind, scorers)) for s, (kind, _) in suites.items()])
    official = F.create_map(*[x for s, (_, n) in suites.items() for x in (F.lit(s), F.lit(n))])
    return df.withColumn("s", score).groupBy("suite").agg(F.count("s").alias("n"), F.avg("s").alias("accuracy")).select(
        "suite", "n", official[F.col("suite")].alias("official_n"), "accuracy")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, rank) with ties sharing the mean rank.

    Distinct values with their counts are sorted by range; each range is summed up from its own beginning and shifted by the rows of the ranges before it, so no task
    sees more than a range, however many distinct values there are.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = cut_lineage(per.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = ranged.groupBy("_part").agg(F.sum("_c").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.withColumn("_upto", F.sum("_c").over(w)).join(shift, "_part").select("_v", (F.col("_before") + F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name))


def spearman(df: DataFrame, x: str, y: str, threshold: float = 0.7) -> DataFrame:
    """rho, n, verdict; 0 for fewer than three pairs or a constant side."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(both, x, "_rx").withColumnRenamed("_v", "_vx")
    ry = average_ranks(both, y, "_ry").withColumnRenamed("_v", "_vy")
    j = both.join(rx, F.col(x) == F.col("_vx")).join(ry, F.col(y) == F.col("_vy"))
    g = j.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("c"))
    rho = F.when((F.col("n") < 3) | F.col("c").isNull() | F.isnan("c"), F.lit(0.0)).otherwise(F.col("c"))
    verdict = F.when(rho >= 0.8, F.lit("excellent")).when(rho >= threshold, F.lit("acceptable")).when(rho >= 0.5, F.lit("low")).otherwise(F.lit("unreliable"))
    return g.select(rho.alias("spearman"), "n", verdict.alias("verdict"))


def pairwise_win_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rounds won by A. ``df``: round, winner (1 first shown, 2 second shown, 0 tie); odd rounds were shown swapped."""
    swap = F.pmod("round", F.lit(2)) == 1
    a_won = F.when(F.col("winner") == 0, 0.0).when((F.col("winner") == 1) != swap, 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(a_won).alias("win_rate_a"), F.count(F.lit(1)).alias("n_rounds"))


def judge_means(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(ru.clamp_judge(F.col(c))).alias(c) for c in ("accuracy", "helpfulness", "tone")])


# ---- yes/no probes ----

def build_probes(images: DataFrame, objects: Sequence[str] = lx.PROBE_OBJECTS, n_per_image: int = 10, n_images: int | None = None,
                 seed: int = 42) -> DataFrame:
    """Half positive, half negative questions per image. ``images``: image, visible array (may be NULL or empty).

    The object list is fixed and short, so candidates are built inside each image row; nothing is crossed or shuffled.
    """
    pick = images if n_images is None else images.orderBy(seeded_key(seed, "image"), "image").limit(n_images)
    vis = F.coalesce("visible", F.array().cast("array<string>"))
    n_pos = n_per_image // 2

    def shuffled(arr: Column, salt: str) -> Column:
        keyed = F.transform(arr, lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), F.col("image"), o).cast("binary")).alias("h"), o.alias("o")))
        return F.transform(F.array_sort(keyed), lambda s: s["o"])

    objs = tx.lit_array(objects)
    pos = F.slice(F.when(F.size(vis) > 0, vis).otherwise(shuffled(objs, "p")), 1, n_pos)
    neg = F.slice(shuffled(F.array_except(objs, vis), "n"), 1, n_per_image - n_pos)
    rows = F.concat(F.transform(pos, lambda o: F.struct(F.lit(True).alias("truth"), o.alias("target"))),
                    F.transform(neg, lambda o: F.struct(F.lit(False).alias("truth"), o.alias("target"))))
    stem = F.regexp_replace(F.substring_index("image", "/", -1), r"\.[^.]*$", "")
    return pick.select("image", stem.alias("stem"), F.explode(rows).alias("r")).select(
        F.concat_ws("_", "stem", F.when(F.col("r.truth"), F.lit("pos")).otherwise(F.lit("neg")), "r.target").alias("qid"), "image",
        F.concat(F.lit("这张图片里的这件衣服有"), "r.target", F.lit("吗？请只回答「有」或「没有」。")).alias("question"),
        F.col("r.truth").alias("ground_truth"), F.lit("existence").alias("probe_type"), F.col("r.target").alias("target"))


def attribute_probes(images: DataFrame, n: int | None = None, seed: int = 42, attributes: Mapping[str, Sequence[str]] = lx.PROBE_ATTRIBUTES) -> DataFrame:
    """Questions about an attribute value that is not the image's; the right answer is no. Two distinct values are picked by
    hash: the image's value ``a`` and the asked value ``b``."""
    from .packing import seeded_pick
    kinds = list(attributes)
    pick = images if n is None else images.orderBy(seeded_key(seed, "image"), "image").limit(n // 2)
    kind = F.pmod(seeded_pick(seed + 1, "image"), F.lit(len(kinds)))
    values = F.get(F.array(*[tx.lit_array(attributes[k]) for k in kinds]), kind.cast("int"))
    size = F.size(values)
    a = F.pmod(seeded_pick(seed + 2, "image"), size)
    b = F.pmod(a + 1 + F.pmod(seeded_pick(seed + 3, "image"), size - 1), size)
    stem = F.regexp_replace(F.substring_index("image", "/", -1), r"\.[^.]*$", "")
    asked = F.get(values, b.cast("int"))
    return pick.select(F.concat_ws("_", stem, F.lit("attr"), asked).alias("qid"), "image",
                       F.concat(F.lit("这件衣服是"), asked, F.lit("色的吗？")).alias("question"), F.lit(False).alias("ground_truth"),
                       F.lit("attribute").alias("probe_type"), asked.alias("target"), F.get(values, a.cast("int")).alias("shown"))


def hallucination_rates(df: DataFrame, keys: Sequence[str] = (), yes: Sequence[str] = lx.YES_WORDS, no: Sequence[str] = lx.NO_WORDS) -> DataFrame:
    """``df``: ground_truth, answer. Unparsed answers leave both denominators; a missing denominator gives NULL."""
    p = df.withColumn("_yn", tx.parse_yes_no(F.col("answer"), yes, no))
    cnt = lambda c: F.count(F.when(c, 1))
    parsed, gt, said = F.col("_yn").isNotNull(), F.col("ground_truth"), F.col("_yn")
    g = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_probes"), cnt(parsed & ~gt).alias("n_negative"), cnt(parsed & gt).alias("n_positive"),
                             cnt(~gt & said).alias("_ny"), cnt(gt & said).alias("_py"), cnt(~parsed).alias("_un"))
    hr = F.col("_ny") / F.nullif("n_negative", F.lit(0))
    ap = F.col("_py") / F.nullif("n_positive", F.lit(0))
    return g.select(*keys, "n_probes", "n_negative", "n_positive", hr.alias("hallucination_rate"), ap.alias("accuracy_on_positive"),
                    (1 - ap).alias("miss_rate"), (F.col("_un") / F.col("n_probes")).alias("unparseable_rate"))


def hallucination_examples(df: DataFrame, n: int = 15) -> DataFrame:
    return (df.filter(~F.col("ground_truth") & tx.parse_yes_no(F.col("answer"))).orderBy("qid").limit(n)
            .select("qid", "question", F.substring("answer", 1, 80).alias("answer"), F.col("target").alias("phantom")))


def mitigation_compare(df: DataFrame, baseline: str = "baseline", **lex) -> DataFrame:
    """Rates per strategy and the change of the hallucination rate against the baseline strategy."""
    r = hallucination_rates(df, ["strategy"], **lex)
    base = r.agg(F.max(F.when(F.col("strategy") == baseline, F.col("hallucination_rate"))))
    return r.withColumn("delta", F.col("hallucination_rate") - base.scalar())
