"""Queries: rule evaluation, run summaries, failure analysis, probes, agreement, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import jsonx, rewards as rw, rules as ru, text as tx
from ..operators import dedup, evaluation as ev, preferences as pr
from ..ordering import rank_in_groups
from ..session import cut_lineage
from . import standins as si
from .registry import query, table

_R = f"WITH {si.RECORDS}"


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("evaluate_rules", "F14 F15 F16 F17 F18 F19 F21 J11", _R + """ SELECT id, mc_ok AS must_contain, round(least(1.0, hits * 2.0 / len(must)), 6) AS must_score, mn_ok AS must_not_contain, rf_ok AS refusal, op_ok AS over_promise,
  pii_ok AS pii, CASE WHEN in_app THEN in_ok END AS intent, passed, round(score, 6) AS score FROM records""")
def evaluate_rules(spark, folder):
    c = lambda n: F.try_element_at("rule.checks", F.lit(n))
    return si.records(spark, folder).select(
        "id", *[c(n)["passed"].alias(n) for n in ("must_contain", "must_not_contain", "refusal", "over_promise", "pii", "intent")],
        F.round(c("must_contain")["score"], 6).alias("must_score"), F.col("rule.passed").alias("passed"), F.round("rule.score", 6).alias("score"))


@query("pii_matches", "F18", r"""SELECT doc_id, len(list_slice(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), 1, 3))::INTEGER AS n_email,
  array_to_string(list_slice(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])([0-9]{16,19})(?:$|[^0-9])', 1), 1, 3), ',') AS cards FROM documents""")
def pii_matches(spark, folder):
    m = ru.pii_matches(F.col("text"))
    size = lambda k: F.coalesce(F.size(F.try_element_at(m, F.lit(k))), F.lit(0))
    cards = F.coalesce(F.array_join(F.try_element_at(m, F.lit("bank_card")), ","), F.lit(""))
    return table(spark, folder, "documents").select("doc_id", F.greatest(size("email"), F.lit(0)).alias("n_email"), cards.alias("cards"))


@query("eval_levels", "A7 A9 F26 X11", _R + """, l AS (SELECT tag, 'run' AS level, '' AS grp, judged.* EXCLUDE (tag) FROM judged UNION ALL SELECT tag, 'tier', tier, judged.* EXCLUDE (tag) FROM judged UNION ALL SELECT tag, 'intent', intent, judged.* EXCLUDE (tag) FROM judged)
SELECT tag, level, grp, count(*) AS n, count(*) FILTER (WHERE is_error) AS n_err, round(count(*) FILTER (WHERE NOT is_error AND passed) / count(*) FILTER (WHERE NOT is_error), 6) AS rule_pass,
  round(avg(score) FILTER (WHERE NOT is_error), 6) AS rule_score, round(avg(judge) FILTER (WHERE NOT is_error), 6) AS judge, count(judge) FILTER (WHERE NOT is_error) AS n_judged, count(*) FILTER (WHERE failed) AS n_fail,
  round(quantile_cont(latency_ms::DOUBLE, 0.5) FILTER (WHERE NOT is_error), 6) AS p50, round(quantile_cont(latency_ms::DOUBLE, 0.95) FILTER (WHERE NOT is_error), 6) AS p95 FROM l GROUP BY tag, level, grp""")
def eval_levels(spark, folder):
    return _round(ev.by_level(_flat(spark, folder)), "rule_pass", "rule_score", "judge", "p50", "p95")


@query("compare_runs", "A8", _R + """, s AS (SELECT tag, count(*)::DOUBLE AS n, count(*) FILTER (WHERE NOT is_error AND passed) / count(*) FILTER (WHERE NOT is_error) AS rule_pass, avg(score) FILTER (WHERE NOT is_error) AS rule_score,
   avg(judge) FILTER (WHERE NOT is_error) AS judge, (count(judge) FILTER (WHERE NOT is_error))::DOUBLE AS n_judged, quantile_cont(latency_ms::DOUBLE, 0.95) FILTER (WHERE NOT is_error) AS p95 FROM judged GROUP BY tag),
 m AS (SELECT tag, unnest(['n', 'rule_pass', 'rule_score', 'judge', 'n_judged', 'p95']) AS metric, unnest([n, rule_pass, rule_score, judge, n_judged, p95]) AS value FROM s)
SELECT metric, round(max(value) FILTER (WHERE tag = 'run_0'), 6) AS run_0, round(max(value) FILTER (WHERE tag = 'run_1'), 6) AS run_1, round(max(value) FILTER (WHERE tag = 'run_2'), 6) AS run_2 FROM m GROUP BY metric""")
def compare_runs(spark, folder):
    return _round(ev.compare_runs(_flat(spark, folder), ["run_0", "run_1", "run_2"]), "run_0", "run_1", "run_2")


_PASS = _R + """, g AS (SELECT tag, tier, count(*) AS n, count(*) FILTER (WHERE NOT is_error AND passed) / count(*) FILTER (WHERE NOT is_error) AS p FROM judged GROUP BY tag, tier)"""


@query("compare_baseline", "J12", _PASS + """ SELECT c.tier, c.n, round(c.p, 6) AS pass_rate, round(b.p, 6) AS base_rate, round(c.p - b.p, 6) AS delta, b.p IS NOT NULL AS has_base
FROM (SELECT * FROM g WHERE tag = 'run_2') c LEFT JOIN (SELECT * FROM g WHERE tag = 'run_0') b USING (tier)""")
def compare_baseline(spark, folder):
    return _round(ev.compare_baseline(_flat(spark, folder), "run_2", "run_0"), "pass_rate", "base_rate", "delta")


_LEVELS = _R + """, l AS (SELECT tag, 'run' AS level, '' AS grp, is_error, passed FROM judged UNION ALL SELECT tag, 'tier', tier, is_error, passed FROM judged UNION ALL SELECT tag, 'intent', intent, is_error, passed FROM judged),
 g AS (SELECT tag, level, grp, count(*) FILTER (WHERE NOT is_error AND passed) / count(*) FILTER (WHERE NOT is_error) AS p FROM l GROUP BY ALL),
 weak AS (SELECT tag, level, arg_min(grp, (p, grp)) AS weakest, min(p) AS low, max(p) - min(p) AS spread FROM g WHERE level <> 'run' GROUP BY tag, level)"""


@query("weakest_group", "A10", _LEVELS + """ SELECT tag, level, weakest, round(low, 6) AS low, round(spread, 6) AS spread, CASE WHEN level = 'tier' AND spread < 0.02 AND low > 0.98 THEN 'no_weak'
  WHEN level = 'intent' AND spread < 0.02 THEN CASE WHEN low > 0.98 THEN 'all_high' ELSE 'tied' END ELSE 'weak' END AS verdict FROM weak""")
def weakest_group(spark, folder):
    return _round(ev.weakest_group(ev.by_level(_flat(spark, folder))), "low", "spread")


@query("ablation_deltas", "A17", _R + """, s AS (SELECT tag, count(*) FILTER (WHERE NOT is_error AND passed) / count(*) FILTER (WHERE NOT is_error) AS p, avg(judge) FILTER (WHERE NOT is_error) AS j FROM judged GROUP BY tag),
 o AS (SELECT CASE tag WHEN 'run_1' THEN 1 WHEN 'run_0' THEN 2 ELSE 3 END::INTEGER AS step, * FROM s)
SELECT step, tag, round(p, 6) AS rule_pass, round(j, 6) AS judge, round(p - lag(p) OVER (ORDER BY step), 6) AS d_pass, round(j - lag(j) OVER (ORDER BY step), 6) AS d_judge FROM o""")
def ablation_deltas(spark, folder):
    s = ev.summary(_flat(spark, folder), ["tag"])
    return _round(ev.ablation_deltas(s, ["run_1", "run_0", "run_2"]), "rule_pass", "judge", "d_pass", "d_judge")


_CHECKS = """, ch AS (SELECT id, 'must_contain' AS "check", mc_ok AS passed FROM records UNION ALL SELECT id, 'must_not_contain', mn_ok FROM records UNION ALL SELECT id, 'refusal', rf_ok FROM records
   UNION ALL SELECT id, 'over_promise', op_ok FROM records UNION ALL SELECT id, 'pii', pii_ok FROM records UNION ALL SELECT id, 'intent', in_ok FROM records WHERE in_app)"""


@query("unnest_checks", "P10", _R + _CHECKS + ' SELECT id, "check", passed FROM ch')
def unnest_checks(spark, folder):
    return ev.unnest_checks(si.records(spark, folder)).select("id", "check", "passed")


@query("failed_checks", "A11 P10", _R + _CHECKS + """, b AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY id) AS rn FROM ch WHERE NOT passed)
SELECT "check", count(*) AS n, round(count(*) / (SELECT count(*) FROM records), 6) AS share, string_agg(id, ',' ORDER BY id) FILTER (WHERE rn <= 2) AS examples FROM b GROUP BY "check" """)
def failed_checks(spark, folder):
    return _round(ev.failed_checks(si.records(spark, folder)), "share")


_G = " ".join(f"WHEN {si.sql_any('(query || text)', ws)} THEN '{g}'" for g, ws in si.GROUPS.items())
_FAILS = f""", fl AS (SELECT *, list_filter([CASE WHEN tier = 'L4' AND NOT rf_ok THEN '未拒答' END, CASE WHEN NOT mc_ok THEN '要素缺失' END, CASE WHEN NOT mn_ok THEN '出现禁用语' END, CASE WHEN NOT op_ok THEN '过度承诺' END,
   CASE WHEN NOT pii_ok THEN 'PII 泄露' END, CASE WHEN in_app AND NOT in_ok THEN '意图识别错' END, CASE WHEN is_error THEN '推理失败' END, CASE WHEN length(text) < 15 THEN '回答过短' END, CASE WHEN length(text) > 500 THEN '回答过长' END,
   CASE WHEN judge_acc <= 2 THEN 'judge 低分' END], lambda x: x IS NOT NULL) AS types, CASE {_G} ELSE '其他' END AS grp FROM judged WHERE failed),
 lb AS (SELECT *, coalesce(types[1], CASE WHEN is_error THEN '调用失败' WHEN score < 0.2 THEN '规则命中极低' ELSE '质量不达标' END) AS label FROM fl)"""


def _fails(spark, folder):
    return ev.failures(si.records(spark, folder), si.GROUPS)


def _narrow(fails):
    """Failure rows without texts, written once: the reports below read them several times."""
    return cut_lineage(fails.select("id", "error_types", "label", "semantic_group", "difficulty", "intent", "query"))


def _flat(spark, folder):
    return cut_lineage(ev.flatten(si.records(spark, folder)))


@query("failures", "F26 F27 X13 X14 X15", _R + _FAILS + " SELECT id, array_to_string(types, ',') AS types, label, grp AS semantic_group FROM lb")
def failures(spark, folder):
    return _fails(spark, folder).select("id", F.array_join("error_types", ",").alias("types"), "label", "semantic_group")


@query("bad_cases", "P9 J11", _R + _FAILS + """ SELECT id, query, text AS model_answer, CASE WHEN doc_id % 4 <> 0 THEN 'ref: ' || substr(text, 1, 40) END AS reference, CASE WHEN len(types) = 0 THEN 'unknown' ELSE array_to_string(types, ',') END AS error_type,
  grp AS semantic_group, tier AS difficulty, CASE WHEN intent <> '未知' THEN intent END AS intent FROM lb""")
def bad_cases(spark, folder):
    return ev.bad_cases(_fails(spark, folder)).drop("images")


@query("pairs_from_bad_cases", "J14", _R + _FAILS + """ SELECT id, query AS prompt, 'ref: ' || substr(text, 1, 40) AS chosen, md5(text) AS rejected, CASE WHEN len(types) = 0 THEN 'unknown' ELSE array_to_string(types, ',') END AS error_type FROM lb WHERE doc_id % 4 <> 0""")
def pairs_from_bad_cases(spark, folder):
    p = pr.pairs_from_bad_cases(ev.bad_cases(_fails(spark, folder)))
    return p.select("id", "prompt", "chosen", F.md5(F.encode("rejected", "utf-8")).alias("rejected"), "error_type")


@query("error_type_counts", "A12 X14 L1", _R + _FAILS + """, u AS (SELECT id, unnest(types) AS error_type FROM lb), r AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY id) AS rn FROM u)
SELECT error_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM lb), 6) AS share, string_agg(id, ',' ORDER BY id) FILTER (WHERE rn <= 3) AS examples FROM r GROUP BY error_type ORDER BY n DESC, error_type LIMIT 10""")
def error_type_counts(spark, folder):
    return _round(ev.error_type_counts(_narrow(_fails(spark, folder)), 10), "share")


@query("semantic_group_counts", "A13 X13 L1", _R + _FAILS + " SELECT grp AS semantic_group, count(*) AS n, round(count(*) / (SELECT count(*) FROM lb), 6) AS share FROM lb GROUP BY grp ORDER BY n DESC, semantic_group LIMIT 10")
def semantic_group_counts(spark, folder):
    return _round(ev.semantic_group_counts(_narrow(_fails(spark, folder)), 10), "share")


@query("tier_intent_crosstab", "A14", _R + _FAILS + """ SELECT tier AS difficulty, count(*) FILTER (WHERE intent = 'en') AS en, count(*) FILTER (WHERE intent = 'fr') AS fr, count(*) FILTER (WHERE intent = 'de') AS de,
  count(*) FILTER (WHERE intent = 'es') AS es FROM lb GROUP BY tier""")
def tier_intent_crosstab(spark, folder):
    return ev.tier_intent_crosstab(_fails(spark, folder), ["en", "fr", "de", "es"])


@query("failure_modes", "A15 X15", _R + _FAILS + " SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM lb), 6) AS share, replace(arg_min(substr(query, 1, 32), id), '|', '／') AS sample FROM lb GROUP BY label")
def failure_modes(spark, folder):
    return _round(ev.failure_modes(_narrow(_fails(spark, folder))), "share")


@query("next_actions", "A16", _LEVELS + _FAILS + """, top AS (SELECT label, count(*) AS n FROM lb GROUP BY label ORDER BY n DESC, label LIMIT 1), d AS (SELECT max(p) FILTER (WHERE tag = 'run_2') - max(p) FILTER (WHERE tag = 'run_0') AS d FROM g WHERE level = 'run')
SELECT CASE WHEN spread < 0.02 AND low > 0.98 THEN 'harder_set' ELSE 'add_data' END AS hint, weakest AS subject, round(low, 6) AS value FROM weak WHERE tag = 'run_0' AND level = 'tier'
UNION ALL SELECT 'top_failure', label, round(n / (SELECT count(*) FROM lb), 6) FROM top
UNION ALL SELECT CASE WHEN abs(d) <= 0.005 THEN 'flat' WHEN d > 0 THEN 'improved' ELSE 'regressed' END, 'run_2', round(d, 6) FROM d""")
def next_actions(spark, folder):
    rec = si.records(spark, folder)
    levels = ev.by_level(_flat(spark, folder))
    return _round(ev.next_actions(levels, ev.failure_modes(_narrow(ev.failures(rec, si.GROUPS))), "run_0", "run_2"), "value")


# ---- evaluation sets ----

@query("build_eval_set", "W5 F31", f"""WITH {si.SAMPLES}, t AS (SELECT * FROM (VALUES ('L1', 'a', 'src1', 2, 1), ('L1', 'b', 'src2', 2, 1), ('L2', 'c', 'de', 2, 2), ('L2', 'd', 'de', 2, 2), ('L2', 'e', 'es', 2, 1), ('L3', 'f', NULL, 1, 1), ('L4', 'g', NULL, 1, 2), ('L4', 'h', NULL, 1, 2)) AS v(tier, template, match, n_keys, n_templates)),
 q AS (SELECT *, greatest(1, (CASE tier WHEN 'L1' THEN 36 WHEN 'L2' THEN 42 WHEN 'L3' THEN 30 ELSE 12 END // n_keys) // n_templates) AS quota FROM t),
 j AS (SELECT q.*, s.id, CASE q.tier WHEN 'L1' THEN image_type = match WHEN 'L2' THEN intent = match WHEN 'L3' THEN image_path IS NOT NULL ELSE true END AS ok FROM q JOIN samples s ON true),
 r AS (SELECT *, row_number() OVER (PARTITION BY tier, template ORDER BY md5('42|' || template || '|' || id), id) AS rn FROM j WHERE ok)
SELECT tier AS difficulty, template, id AS src_id FROM r WHERE rn <= quota""")
def build_eval_set(spark, folder):
    rows = [("L1", "a", "src1", 2, 1), ("L1", "b", "src2", 2, 1), ("L2", "c", "de", 2, 2), ("L2", "d", "de", 2, 2), ("L2", "e", "es", 2, 1), ("L3", "f", None, 1, 1), ("L4", "g", None, 1, 2), ("L4", "h", None, 1, 2)]
    tm = spark.createDataFrame([(*r, "question " + r[1], ["x"], [], False) for r in rows], "tier string, template string, match string, n_keys int, n_templates int, query string, "
                               "must_contain array<string>, must_not_contain array<string>, should_refuse boolean")
    return ev.build_eval_set(_pool(spark, folder), tm, 120).select("difficulty", "template", "src_id")


def _pool(spark, folder):
    s = si.samples(spark, folder, messages=False)
    return s.select("id", "image_type", "intent", F.array_compact(F.array("image_path")).alias("images"))


@query("empty_tiers", "F31", "SELECT tier FROM (VALUES ('L1'), ('L2'), ('L3'), ('L4')) AS t(tier) WHERE tier NOT IN (SELECT 'L' || CAST(doc_id % 3 + 1 AS VARCHAR) FROM documents)")
def empty_tiers(spark, folder):
    d = table(spark, folder, "documents").select(F.concat(F.lit("L"), (F.col("doc_id") % 3 + 1).cast("string")).alias("difficulty"))
    return ev.empty_tiers(d)


@query("eval_card", "A36 J4", f"""WITH {si.FINGERPRINTS}, {si.SAMPLES}, pairs AS (SELECT e.doc_id AS ev FROM prints e JOIN prints t ON e.doc_id % 5 = 0 AND t.doc_id % 5 <> 0 AND bit_count(xor(e.phash, t.phash)) < 8),
 e AS (SELECT * FROM samples WHERE seq % 5 = 0), l AS (SELECT 'difficulty' AS dimension, CAST((seq // 5) % 4 AS VARCHAR) AS value, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'intent', intent, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'image_type', image_type, count(*) FROM e GROUP BY ALL)
SELECT dimension, value, n, round(n / (SELECT count(*) FROM e), 6) AS share FROM l
UNION ALL SELECT 'leakage', CASE WHEN (SELECT count(*) FROM pairs) > 0 THEN 'leaking' ELSE 'clean' END, (SELECT count(*) FROM prints WHERE doc_id % 5 = 0), round((SELECT count(DISTINCT ev) FROM pairs) / (SELECT count(*) FROM prints WHERE doc_id % 5 = 0), 6)""")
def eval_card(spark, folder):
    from .cleaning import _leak_sides
    e = si.samples(spark, folder, messages=False).filter("seq % 5 = 0").withColumn("difficulty", F.pmod(F.floor(F.col("seq") / 5), F.lit(4)))
    return _round(ev.eval_card(e, dedup.leakage_report(*_leak_sides(spark, folder))), "share")


# a sample asks with a whole text; all its distinct words must be in the answer, and of every eleventh text the first word must not
_SET = """SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE text END AS query, list_distinct(string_split(text, ' ')) AS must,
   [CASE WHEN doc_id % 11 = 0 THEN string_split(text, ' ')[1] ELSE 'zzz' END] AS forbid, doc_id % 7 = 0 AS refuse FROM documents"""


def _template_set(spark, folder):
    d = table(spark, folder, "documents").withColumn("words", F.split("text", " "))
    i = F.col("doc_id")
    return d.select(i.alias("id"), F.when(i % 97 == 0, F.lit("x")).otherwise(F.col("text")).alias("query"), F.array_distinct("words").alias("must_contain"),
                    F.array(F.when(i % 11 == 0, F.get("words", F.lit(0))).otherwise(F.lit("zzz"))).alias("must_not_contain"), (i % 7 == 0).alias("should_refuse"), F.lit(None).cast("string").alias("expected_intent"))


@query("lint_templates", "F28", f"""WITH s AS ({_SET}) SELECT doc_id AS id, 'short_query' AS problem FROM s WHERE length(query) < 3 UNION ALL SELECT doc_id, 'meta_word' FROM s WHERE len(list_filter(must, lambda k: contains(k, '###'))) > 0
UNION ALL SELECT doc_id, 'blank_word' FROM s WHERE len(list_filter(must, lambda k: regexp_full_match(k, '\\s*'))) > 0 UNION ALL SELECT doc_id, 'contradiction' FROM s WHERE list_has_any(must, forbid)""")
def lint_templates(spark, folder):
    return ev.lint_templates(_template_set(spark, folder), ("###",))


@query("lint_texts", "F29", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line FROM documents)
SELECT doc_id, line, w AS word FROM l, (VALUES ('that was'), ('les que'), ('und der')) AS v(w) WHERE contains(t, w)""")
def lint_texts(spark, folder):
    return ev.lint_texts(table(spark, folder, "documents"), ("that was", "les que", "und der"), "doc_id")


@query("oracle_failures", "F32", f"""WITH s AS ({_SET}), a AS (SELECT *, CASE WHEN refuse THEN 'que la info' ELSE array_to_string(list_filter(must, lambda k: NOT list_contains(forbid, k)), '、') END AS ans FROM s),
 c AS (SELECT doc_id, len(list_filter(must, lambda k: contains(ans, k))) > 0 AS mc, NOT contains(ans, forbid[1]) AS mn, contains(ans, 'que la') = refuse AS rf,
   NOT {si.sql_any('ans', si.PROMISES)} AS op, NOT {si._PII_SQL.replace('text', 'ans')} AS pii FROM a) SELECT doc_id AS id FROM c WHERE NOT (mc AND mn AND rf AND op AND pii)""")
def oracle_failures(spark, folder):
    return ev.oracle_failures(_template_set(spark, folder), "que la info", refusals=("que la",), promises=si.PROMISES).select("id")


@query("calibration_sheet", "W15", _R + """ SELECT id, tier AS difficulty, query, CASE WHEN doc_id % 4 <> 0 THEN 'ref: ' || substr(text, 1, 40) ELSE '+' || array_to_string(must, ',') || ' -' || array_to_string(forbid, ',') END AS expected,
  refuse AS should_refuse FROM records ORDER BY md5('42|' || id), id LIMIT 50""")
def calibration_sheet(spark, folder):
    return ev.calibration_sheet(si.records(spark, folder)).drop("images")


@query("first_eval_rows", "L2", _R + " SELECT id, tag FROM records ORDER BY doc_id LIMIT 100")
def first_eval_rows(spark, folder):
    return si.records(spark, folder).orderBy(F.col("id").cast("long")).limit(100).select("id", "tag")


# ---- suites, agreement ----

# an item's gold answers are the whole texts of the two items before it; every other item of a containment suite repeats a gold inside its answer
_SUITE = """SELECT item_id, ['ocrbench', 'mmbench', 'pope', 'docvqa'][item_id % 4 + 1] AS suite, CASE WHEN item_id % 3 = 0 THEN text || ' ' || coalesce(lag(text, 2) OVER w, '') ELSE text END AS answer,
   [coalesce(lag(text, 1) OVER w, ''), coalesce(lag(text, 2) OVER w, '')] AS golds FROM benchmark WINDOW w AS (ORDER BY item_id)"""
_NORM = "regexp_replace(lower({x}), '\\s+', '', 'g')"
# DuckDB counts the bytes of an edit; letters beyond ASCII stand for capitals there, which lower() has left unused
_ONE_BYTE = f"translate({_NORM}, 'ßäçèéêíñóöüàâîôûùëïáúæœ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
_OCR = "greatest(0.0, 1.0 - levenshtein({a}, {g}) / greatest(length({a}), length({g}), 1))"


@query("suite_accuracy", "A23 X8 X9 X10 U1", f"""WITH s AS ({_SUITE}), n AS (SELECT suite, {_ONE_BYTE.format(x='answer')} AS a, {_ONE_BYTE.format(x='golds[1]')} AS g1, {_ONE_BYTE.format(x='golds[2]')} AS g2 FROM s),
 v AS (SELECT suite, CASE WHEN suite IN ('mmbench', 'pope') THEN greatest((g1 <> '' AND contains(a, g1))::INT, (g2 <> '' AND contains(a, g2))::INT)::DOUBLE ELSE greatest({_OCR.format(a='a', g='g1')}, {_OCR.format(a='a', g='g2')}) END AS s FROM n)
SELECT suite, count(*) AS n, CASE suite WHEN 'ocrbench' THEN 1000 WHEN 'docvqa' THEN 5000 ELSE 3000 END::INTEGER AS official_n, round(avg(s), 6) AS accuracy FROM v GROUP BY suite""")
def suite_accuracy(spark, folder):
    suites = F.array(*[F.lit(s) for s in ("ocrbench", "mmbench", "pope", "docvqa")])
    b = _with_golds(spark, folder)
    two = F.concat("text", F.lit(" "), F.get("golds", F.lit(1)))
    s = b.select(F.get(suites, (F.col("item_id") % 4).cast("int")).alias("suite"), F.when(F.col("item_id") % 3 == 0, two).otherwise(F.col("text")).alias("answer"), "golds")
    return _round(ev.suite_accuracy(s), "accuracy")


def _with_golds(spark, folder):
    """Items with the whole texts of the two items before them as gold answers."""
    b = table(spark, folder, "benchmark").select("item_id", "text")
    ranked = rank_in_groups(b.withColumn("_g", F.lit(0)), ["_g"], [F.col("item_id")], F.floor(F.col("item_id") / 1000), "_at").drop("_g")
    one, two = (ranked.select((F.col("_at") + k).alias("_at"), F.col("text").alias(f"_g{k}")) for k in (1, 2))
    return ranked.join(one, "_at", "left").join(two, "_at", "left").select("item_id", "text", F.array(F.coalesce("_g1", F.lit("")), F.coalesce("_g2", F.lit(""))).alias("golds"))


@query("edit_similarity", "X8 X9", f"""WITH n AS (SELECT item_id, {_NORM.format(x='text')} AS norm, {_ONE_BYTE.format(x='text')} AS a, {_ONE_BYTE.format(x="coalesce(before, '')")} AS g
   FROM (SELECT *, lag(text) OVER (ORDER BY item_id) AS before FROM benchmark)) SELECT item_id, norm, round({_OCR.format(a='a', g='g')}, 6) AS sim FROM n""")
def edit_similarity(spark, folder):
    a, g = tx.norm_text(F.col("text")), tx.norm_text(F.get("golds", F.lit(0)))
    return _with_golds(spark, folder).select("item_id", a.alias("norm"), F.round(tx.edit_similarity(a, g), 6).alias("sim"))


@query("spearman", "A20", """WITH b AS (SELECT l_quantity AS x, l_discount * 100 + l_linenumber AS y FROM lineitem), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b)
SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n, CASE WHEN corr(rx, ry) >= 0.8 THEN 'excellent' WHEN corr(rx, ry) >= 0.7 THEN 'acceptable' WHEN corr(rx, ry) >= 0.5 THEN 'low' ELSE 'unreliable' END AS verdict FROM r""")
def spearman(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("y"))
    return _round(ev.spearman(li, "x", "y"), "spearman")


@query("judge_agreement", "A20 X12", """WITH b AS (SELECT greatest(1, least(5, 1 + 4 * quality)) AS x, greatest(1, least(5, length(text) // 800 + toxic)) AS y FROM labels JOIN documents USING (doc_id)),
 r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b)
SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n, 'unreliable' AS verdict FROM r""")
def judge_agreement(spark, folder):
    j = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return _round(ev.spearman(j.select(ru.clamp_judge(1 + 4 * F.col("quality")).alias("x"), ru.clamp_judge(F.floor(F.length("text") / 800) + F.col("toxic")).alias("y")), "x", "y"), "spearman")


@query("pairwise_win_rate", "A21", """SELECT l_suppkey, round(avg(CASE WHEN w = 0 THEN 0.0 WHEN (w = 1) <> (l_linenumber % 2 = 1) THEN 1.0 ELSE 0.0 END), 6) AS win_rate_a, count(*) AS n_rounds
FROM (SELECT *, l_partkey % 3 AS w FROM lineitem) GROUP BY l_suppkey""")
def pairwise_win_rate(spark, folder):
    li = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("round"), (F.col("l_partkey") % 3).alias("winner"))
    return _round(ev.pairwise_win_rate(li, ["l_suppkey"]), "win_rate_a")


@query("judge_means", "A22 X12", """SELECT quality, round(avg(greatest(1, least(5, 7 * quality))), 6) AS accuracy, round(avg(greatest(1, least(5, coalesce(CASE WHEN toxic = 1 THEN NULL ELSE 5 END, 3)))), 6) AS helpfulness, round(avg(3 + quality), 6) AS tone FROM labels GROUP BY quality""")
def judge_means(spark, folder):
    lab = table(spark, folder, "labels").select("quality", (7 * F.col("quality")).alias("accuracy"), F.when(F.col("toxic") != 1, F.lit(5)).alias("helpfulness"), (3 + F.col("quality")).alias("tone"))
    return _round(ev.judge_means(lab, ["quality"]), "accuracy", "helpfulness", "tone")


# ---- probes ----

_YN = f"""CASE WHEN {' OR '.join(f"starts_with(head, '{w}')" for w in si.YES)} THEN true WHEN {' OR '.join(f"starts_with(head, '{w}')" for w in si.NO)} THEN false
  WHEN {si.sql_any('a', si.YES)} AND NOT {si.sql_any('a', si.NO)} THEN true WHEN {si.sql_any('a', si.NO)} AND NOT {si.sql_any('a', si.YES)} THEN false END"""
_PROBED = f"""p AS (SELECT conv_id, turn, turn % 2 = 0 AS truth, ['baseline', 'prompt_constraint', 'evidence_first'][conv_id % 3 + 1] AS strategy, trim(text, ' ' || chr(10) || chr(9)) AS a FROM conversations),
 y AS (SELECT *, {_YN} AS yn FROM (SELECT *, substr(a, 1, 20) AS head FROM p))"""
_RATES = """count(*) AS n_probes, count(*) FILTER (WHERE yn IS NOT NULL AND NOT truth) AS n_negative, count(*) FILTER (WHERE yn IS NOT NULL AND truth) AS n_positive,
 round(count(*) FILTER (WHERE yn AND NOT truth) / nullif(count(*) FILTER (WHERE yn IS NOT NULL AND NOT truth), 0), 6) AS hallucination_rate, round(count(*) FILTER (WHERE yn AND truth) / nullif(count(*) FILTER (WHERE yn IS NOT NULL AND truth), 0), 6) AS accuracy_on_positive,
 round(1 - count(*) FILTER (WHERE yn AND truth) / nullif(count(*) FILTER (WHERE yn IS NOT NULL AND truth), 0), 6) AS miss_rate, round(count(*) FILTER (WHERE yn IS NULL) / count(*), 6) AS unparseable_rate"""


def _probed(spark, folder):
    c = table(spark, folder, "conversations")
    names = F.array(*[F.lit(s) for s in ("baseline", "prompt_constraint", "evidence_first")])
    return c.select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("ground_truth"), F.get(names, (F.col("conv_id") % 3).cast("int")).alias("strategy"), F.col("text").alias("answer"))


@query("parse_yes_no", "X7", f"WITH {_PROBED} SELECT conv_id, turn, yn AS parsed FROM y")
def parse_yes_no(spark, folder):
    return _probed(spark, folder).select("conv_id", "turn", tx.parse_yes_no(F.col("answer"), si.YES, si.NO).alias("parsed"))


@query("hallucination_rates", "A18 X7", f"WITH {_PROBED} SELECT {_RATES} FROM y")
def hallucination_rates(spark, folder):
    return _round(ev.hallucination_rates(_probed(spark, folder), (), si.YES, si.NO), "hallucination_rate", "accuracy_on_positive", "miss_rate", "unparseable_rate")


@query("mitigation_compare", "A19", f"WITH {_PROBED}, r AS (SELECT strategy, {_RATES}, count(*) FILTER (WHERE yn AND NOT truth) / nullif(count(*) FILTER (WHERE yn IS NOT NULL AND NOT truth), 0) AS h FROM y GROUP BY strategy) SELECT r.* EXCLUDE (h), round(h - (SELECT h FROM r WHERE strategy = 'baseline'), 6) AS delta FROM r")
def mitigation_compare(spark, folder):
    return _round(ev.mitigation_compare(_probed(spark, folder), yes=si.YES, no=si.NO), "hallucination_rate", "accuracy_on_positive", "miss_rate", "unparseable_rate", "delta")


_OBJ = si.sql_list(lx.PROBE_OBJECTS)


@query("build_probes", "J25 L4", f"""WITH i AS (SELECT 'p/' || CAST(page_id AS VARCHAR) || '.jpg' AS image, CAST(page_id AS VARCHAR) AS stem, CASE WHEN page_id % 2 = 0 THEN ['口袋', '拉链', '纽扣', '腰带', '帽子', '围巾'] ELSE [] END AS vis FROM pages),
 c AS (SELECT image, stem, vis, unnest({_OBJ}) AS o FROM i), pp AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY md5('42p|' || image || '|' || o), o) AS rn FROM c WHERE len(vis) = 0),
 nn AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY md5('42n|' || image || '|' || o), o) AS rn FROM c WHERE NOT list_contains(vis, o)),
 r AS (SELECT image, stem, o, true AS truth FROM pp WHERE rn <= 5 UNION ALL SELECT image, stem, unnest(vis[1:5]), true FROM i WHERE len(vis) > 0 UNION ALL SELECT image, stem, o, false FROM nn WHERE rn <= 5)
SELECT stem || CASE WHEN truth THEN '_pos_' ELSE '_neg_' END || o AS qid, image, '这张图片里的这件衣服有' || o || '吗？请只回答「有」或「没有」。' AS question, truth AS ground_truth, 'existence' AS probe_type, o AS target FROM r""")
def build_probes(spark, folder):
    return ev.build_probes(_images(spark, folder))


def _images(spark, folder):
    vis = F.array(*[F.lit(o) for o in lx.PROBE_OBJECTS[:6]])
    return table(spark, folder, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("image"),
                                                F.when(F.col("page_id") % 2 == 0, vis).otherwise(F.array().cast("array<string>")).alias("visible"))


_PICK = "('0x' || substr(md5('{}|' || image), 1, 8))::BIGINT"
_ATTRS = "[" + ", ".join(si.sql_list(v) for v in lx.PROBE_ATTRIBUTES.values()) + "]"


@query("attribute_probes", "J26 L4", f"""WITH i AS (SELECT 'p/' || CAST(page_id AS VARCHAR) || '.jpg' AS image, CAST(page_id AS VARCHAR) AS stem FROM pages),
 v AS (SELECT *, {_ATTRS}[{_PICK.format(43)} % {len(lx.PROBE_ATTRIBUTES)} + 1] AS vals FROM i), x AS (SELECT *, {_PICK.format(44)} % len(vals) AS a FROM v),
 y AS (SELECT *, (a + 1 + {_PICK.format(45)} % (len(vals) - 1)) % len(vals) AS b FROM x)
SELECT stem || '_attr_' || vals[b + 1] AS qid, image, '这件衣服是' || vals[b + 1] || '色的吗？' AS question, false AS ground_truth, 'attribute' AS probe_type, vals[b + 1] AS target, vals[a + 1] AS shown FROM y""")
def attribute_probes(spark, folder):
    return ev.attribute_probes(_images(spark, folder))


# ---- JSON, claims, rewards over the event payloads and texts ----

def _completions(spark, folder):
    e = table(spark, folder, "events")
    k, t = F.regexp_extract("props", "[0-9]+", 0), F.col("event_type")
    body = F.format_string('{"action": "%s", "action_input": {"k": "%s", "t": "%s"}, "answer": "%s"}', t, k, t, F.col("user_id").cast("string"))
    text = (F.when(F.col("event_id") % 5 == 0, body).when(F.col("event_id") % 5 == 1, F.concat(F.lit("看图：浅蓝色圆领\n```json\n"), body, F.lit("\n```")))
            .when(F.col("event_id") % 5 == 2, F.concat(F.lit("so {broken "), body, F.lit(" 需要确认"))).when(F.col("event_id") % 5 == 3, F.col("props")).otherwise(F.lit("红色 {no json 线头")))
    return e.select("event_id", text.alias("completion"), F.when(F.col("event_id") % 4 != 0, F.lit("click")).alias("expected_tool"), F.create_map(F.lit("k"), k, F.lit("t"), F.lit("click")).alias("expected_slots"),
                    F.array(F.lit("click"), F.lit("view"), F.lit("purchase")).alias("allowed_tools"), F.array(F.lit("浅蓝色裤"), F.lit("线头")).alias("visible_objects"),
                    (F.col("user_id") % 3 == 0).alias("should_refuse"), F.lit(30).alias("target_length"))


_COMP = """c0 AS (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events), c1 AS (SELECT *, '{"action": "' || event_type || '", "action_input": {"k": "' || k || '", "t": "' || event_type || '"}, "answer": "' || user_id || '"}' AS body FROM c0),
 c AS (SELECT event_id, event_type, k, user_id, event_id % 5 AS kind, CASE event_id % 5 WHEN 0 THEN body WHEN 1 THEN '看图：浅蓝色圆领' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'so {broken ' || body || ' 需要确认' WHEN 3 THEN props ELSE '红色 {no json 线头' END AS txt,
   CASE WHEN event_id % 5 <= 2 THEN body WHEN event_id % 5 = 3 THEN props END AS js, CASE WHEN event_id % 4 <> 0 THEN 'click' END AS want, user_id % 3 = 0 AS refuse FROM c1)"""


@query("extract_json", "X4 F20", f"WITH {_COMP} SELECT event_id, js AS parsed, js IS NOT NULL AND kind <> 3 AS passed, CASE WHEN js IS NULL THEN 0.0 WHEN kind = 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM c")
def extract_json(spark, folder):
    c = _completions(spark, folder).withColumn("parsed", jsonx.extract_json(F.col("completion")))
    chk = ru.check_json_keys(F.col("parsed"), ("action", "answer"))
    return c.select("event_id", "parsed", chk["passed"].alias("passed"), chk["score"].alias("score"))


# in these completions the claims are: kind 1 mentions two lexicon words (one related to what is visible), kind 4 one phantom and one visible object
@query("reward_parts", "X16 X25 X26", f"""WITH {_COMP}, r AS (SELECT event_id, CASE WHEN js IS NULL OR kind = 3 THEN 0.0 ELSE 1.0 END AS format,
   CASE WHEN js IS NULL THEN 0.0 WHEN kind = 3 THEN CASE WHEN want IS NULL THEN 1.0 ELSE 0.0 END WHEN want IS NULL THEN 0.0 WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 0.0 WHEN event_type = want THEN 1.0 ELSE 0.0 END AS tool,
   CASE WHEN js IS NULL OR kind = 3 THEN 0.0 ELSE (1 + (event_type = 'click')::INT) / 2 END * 0.5 AS slot, CASE kind WHEN 1 THEN 0.5 WHEN 4 THEN 0.5 ELSE 0.5 END * 0.8 AS grounding, CASE kind WHEN 1 THEN -1.0 WHEN 4 THEN -1.0 ELSE 0.0 END AS hallucination,
   CASE WHEN refuse THEN (kind = 2)::INT ELSE CASE WHEN kind = 2 THEN -0.5 ELSE 1.0 END END * 0.5 AS refusal, greatest(0, length(txt) - 60) / 100 * -0.1 AS len FROM c)
SELECT event_id, round(format::DOUBLE, 6) AS format, round(tool::DOUBLE, 6) AS tool, round(slot::DOUBLE, 6) AS slot, round(grounding::DOUBLE, 6) AS grounding, round(hallucination::DOUBLE, 6) AS hallucination, round(refusal::DOUBLE, 6) AS refusal, round(len::DOUBLE, 6) AS length,
  round((format + tool + slot + grounding + hallucination + refusal + len)::DOUBLE, 6) AS total FROM r""")
def reward_parts(spark, folder):
    r = pr.score_rewards(_completions(spark, folder)).select("event_id", "reward.*")
    return _round(r, *[c for c in r.columns if c != "event_id"])


@query("visual_claims", "X16", f"""WITH {_COMP} SELECT event_id, CASE kind WHEN 1 THEN '浅蓝色' WHEN 4 THEN '线头' ELSE '' END AS grounded, CASE kind WHEN 1 THEN '圆领' WHEN 4 THEN '红色' ELSE '' END AS phantom FROM c""")
def visual_claims(spark, folder):
    c = _completions(spark, folder).withColumn("v", rw.visual_claims(F.col("completion"), F.col("visible_objects")))
    return c.select("event_id", F.array_join("v.grounded", ",").alias("grounded"), F.array_join("v.phantom", ",").alias("phantom"))
