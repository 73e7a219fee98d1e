"""Queries: training-set shape, supervision, buckets, splits, plans and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as lx, schemas as sc
from ..functions import rules as ru, text as tx, vision as vi
from ..operators import evaluation as ev, packing as pk, preferences as pr, stages as st
from . import standins as si
from .registry import query, table


def _flat_messages(df, sep):
    body = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return F.array_join(body, sep)


@query("to_sharegpt", "P2 S5", f"""WITH {si.SAMPLES} SELECT id, 'system=sys' || '##' || 'user=<image>' || chr(10) || user_text || CASE WHEN reply_text IS NULL THEN '' ELSE '##assistant=' || reply_text END AS turns,
  CASE WHEN image_path IS NULL THEN '' WHEN image_path LIKE '\\_\\_%' ESCAPE '\\' THEN image_path ELSE '/data/' || string_split(image_path, '/')[-1] END AS images, intent, difficulty FROM samples""")
def to_sharegpt(spark, folder):
    t = pk.to_sharegpt(si.samples(spark, folder), "sys", "/data")
    return t.select("id", _flat_messages(t, "##").alias("turns"), F.array_join("images", ",").alias("images"), "intent", "difficulty")


@query("conversation_tags", "S5", f"""WITH {si.SAMPLES} SELECT id, CASE WHEN reply_text IS NULL THEN 2 ELSE 3 END AS n, coalesce(reply_text, '<image>' || chr(10) || user_text) AS last_value FROM samples""")
def conversation_tags(spark, folder):
    t = pk.to_conversation_tags(pk.to_sharegpt(si.samples(spark, folder), "sys"))
    return t.select("id", F.size("conversations").alias("n"), F.element_at("conversations", -1)["value"].alias("last_value"))


_TOK = "CASE WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9)), '\\s+')) END"
_SPANS = f"""w AS (SELECT conv_id, turn, role, CAST({_TOK} + 3 AS BIGINT) AS width FROM conversations),
 s AS (SELECT conv_id, turn, role, width, CAST(sum(width) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM w),
 spans AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN stop - width + 2 ELSE stop - width END AS "start", stop AS "end", role = 'assistant' AS supervised FROM s)"""


@query("assistant_spans", "P3", f'WITH {_SPANS} SELECT * FROM spans')
def assistant_spans(spark, folder):
    return pk.assistant_spans(table(spark, folder, "conversations"))


@query("supervision_stats", "A38 P3", f"""WITH {_SPANS}, p AS (SELECT conv_id, max("end") AS n_total, CAST(sum(CASE WHEN supervised THEN "end" - "start" ELSE 0 END) AS BIGINT) AS n_supervised FROM spans GROUP BY conv_id)
SELECT conv_id, n_total, n_supervised, round(n_supervised / n_total, 6) AS share FROM p WHERE n_supervised >= 5""")
def supervision_stats(spark, folder):
    return pk.supervision_stats(pk.assistant_spans(table(spark, folder, "conversations"))).withColumn("share", F.round("share", 6))


_LEN = "SELECT doc_id, length(text) // 4 AS n FROM documents"
_BUCKETS = f"""b AS (SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(least(n // 256, 4) AS INTEGER) AS bucket, md5('42|' || CAST(doc_id AS VARCHAR)) AS h FROM ({_LEN})),
 p AS (SELECT doc_id, n, bucket, CAST((row_number() OVER (PARTITION BY bucket ORDER BY n, h) - 1) // 8 AS BIGINT) AS batch FROM b)"""


def _packed(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("n"))
    return pk.pack_by_bucket(d, "n", "doc_id")


@query("pack_by_bucket", "P4", f"WITH {_BUCKETS} SELECT doc_id, n, bucket, batch FROM p")
def pack_by_bucket(spark, folder):
    return _packed(spark, folder)


@query("pad_waste", "P5 P4", f"""WITH {_BUCKETS} SELECT bucket, batch, count(*) AS n, CAST(sum(n) AS BIGINT) AS used, max(n) AS longest, round(1 - sum(n) / (max(n) * count(*)), 6) AS waste FROM p GROUP BY bucket, batch""")
def pad_waste(spark, folder):
    return pk.pad_waste(_packed(spark, folder), "n").withColumn("waste", F.round("waste", 6))


_PROMPT_SQL = ("'请写一轮客服对话。' || chr(10) || '商品：' || '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' || chr(10) || '图片：' || p_type || '（' || p_name || '）' || chr(10) || "
               "'顾客：焦虑型（语气急，反复确认，容易担心买错），此刻平静' || chr(10) || '想问：' || p_brand || '（b' || p_size || '），难度 ' || (p_size % 5 + 1) || chr(10) || CASE WHEN p_partkey % 17 = 0 THEN '信息不足：请以追问为主' WHEN p_partkey % 19 = 0 THEN '超出范围：先安抚，再转人工' ELSE '' END")


@query("build_prompts", "P6", f"SELECT p_partkey, {_PROMPT_SQL} AS prompt FROM part")
def build_prompts(spark, folder):
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    kind = F.when(k % 17 == 0, F.lit("clarify")).when(k % 19 == 0, F.lit("escalate")).otherwise(F.lit("normal"))
    fields = {"product": F.to_json(F.struct("p_partkey", "p_name", "p_size")), "image_type_name": F.col("p_type"), "caption": F.col("p_name"), "persona": F.lit(lx.PERSONAS[0][0]), "persona_description": F.lit(lx.PERSONAS[0][1]),
              "emotion": F.lit(lx.EMOTIONS[0]), "intent_name": F.col("p_brand"), "intent_description": F.concat(F.lit("b"), F.col("p_size").cast("string")), "difficulty": F.col("p_size") % 5 + 1}
    return p.select("p_partkey", pk.build_prompt(fields, kind).alias("prompt"))


@query("visual_tokens", "X17 X18", """WITH s AS (SELECT page_id, (length(html) % 3000 + 20)::DOUBLE AS w, (length(url) * 37 % 2000 + 20)::DOUBLE AS h FROM pages),
 r AS (SELECT *, greatest(28.0, round_even(h / 28, 0) * 28) AS h0, greatest(28.0, round_even(w / 28, 0) * 28) AS w0, sqrt(h * w / 1003520.0) AS sh, sqrt(3136.0 / (h * w)) AS gr FROM s WHERE h >= 28 AND w >= 28),
 t AS (SELECT page_id, CAST(CASE WHEN h0 * w0 > 1003520 THEN greatest(28.0, floor(h / sh / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(h * gr / 28) * 28 ELSE h0 END AS INTEGER) AS hb,
   CAST(CASE WHEN h0 * w0 > 1003520 THEN greatest(28.0, floor(w / sh / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(w * gr / 28) * 28 ELSE w0 END AS INTEGER) AS wb FROM r)
SELECT page_id, hb AS h, wb AS w, CAST((hb // 14 // 2) * (wb // 14 // 2) AS INTEGER) AS tokens FROM t""")
def visual_tokens(spark, folder):
    p = si.page_sizes(spark, folder)
    s, v = vi.smart_resize(F.col("h"), F.col("w")), vi.visual_tokens(F.col("h"), F.col("w"))
    return p.select("page_id", s["h"].alias("h_"), s["w"].alias("w_"), v["tokens"].alias("tokens")).filter("tokens is not null").withColumnsRenamed({"h_": "h", "w_": "w"})


@query("visual_token_stats", "A26 X18", """WITH s AS (SELECT (length(html) % 3000 + 20)::DOUBLE AS w, (length(url) * 37 % 2000 + 20)::DOUBLE AS h FROM pages),
 r AS (SELECT *, greatest(28.0, round_even(h / 28, 0) * 28) AS h0, greatest(28.0, round_even(w / 28, 0) * 28) AS w0, sqrt(h * w / 1003520.0) AS sh, sqrt(3136.0 / (h * w)) AS gr FROM s WHERE h >= 28 AND w >= 28),
 t AS (SELECT CAST(CASE WHEN h0 * w0 > 1003520 THEN greatest(28.0, floor(h / sh / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(h * gr / 28) * 28 ELSE h0 END AS INTEGER) AS hb,
   CAST(CASE WHEN h0 * w0 > 1003520 THEN greatest(28.0, floor(w / sh / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(w * gr / 28) * 28 ELSE w0 END AS INTEGER) AS wb FROM r),
 v AS (SELECT CAST((hb // 14 // 2) * (wb // 14 // 2) AS INTEGER) AS n FROM t)
SELECT count(*) AS n_images, CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(n), 6) AS mean, max(n) AS max, min(n) AS min, quantile_disc(n::DOUBLE, 0.5) AS median,
  round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99 FROM v""")
def visual_token_stats(spark, folder):
    s = pk.visual_token_stats(si.page_sizes(spark, folder), "h", "w")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "p90", "p99")})


# ---- splits ----

_GROUPED = f"""{si.SAMPLES}, k AS (SELECT *, CASE WHEN image_path IS NULL OR image_path = '' OR starts_with(image_path, '__') THEN '__solo_' || CAST(seq AS VARCHAR) ELSE image_path END AS group_key FROM samples),
 per AS (SELECT group_key, intent, image_type, count(*) AS n, min(seq) AS f FROM k GROUP BY ALL),
 st AS (SELECT group_key, CAST(sum(n) AS BIGINT) AS size, arg_max(intent || '|' || image_type, n * 1000000000 - f) AS stratum FROM per GROUP BY group_key),
 rk AS (SELECT *, md5('42|' || group_key) AS h, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || group_key), group_key) AS r FROM st),
 nb AS (SELECT *, (row_number() OVER (ORDER BY size, r, h, group_key) - 1) % 10 AS slot, count(*) OVER () AS g FROM rk),
 sp AS (SELECT group_key, CASE WHEN g < 3 THEN 'train' WHEN slot = CASE WHEN g < 10 THEN 0 ELSE 4 END THEN 'test' WHEN slot = CASE WHEN g < 10 THEN 1 ELSE 5 END THEN 'val' ELSE 'train' END AS split FROM nb),
 splits AS (SELECT k.*, split FROM k JOIN sp USING (group_key))"""


@query("split_by_group", "W3", f"WITH {_GROUPED} SELECT seq, group_key, split FROM splits")
def split_by_group(spark, folder):
    return pk.split_by_group(si.samples(spark, folder, messages=False)).select("seq", "group_key", "split")


@query("split_by_group_ratios", "W3", f"""WITH {_GROUPED}, own AS (SELECT group_key, CASE WHEN g < 3 THEN 'train' WHEN slot BETWEEN 4 AND 6 THEN 'test' WHEN slot BETWEEN 7 AND 8 THEN 'val' ELSE 'train' END AS split FROM nb)
SELECT seq, group_key, own.split FROM k JOIN own USING (group_key)""")
def split_by_group_ratios(spark, folder):
    """Three tenths of the groups to test, two to validation."""
    return pk.split_by_group(si.samples(spark, folder, messages=False), eval_ratio=0.2, test_ratio=0.3).select("seq", "group_key", "split")


@query("split_overlap", "J6 F30 L5", f"WITH {_GROUPED}, m AS (SELECT image_path, CASE WHEN seq % 49 = 0 THEN 'test' ELSE split END AS split FROM splits WHERE image_path IS NOT NULL AND NOT starts_with(image_path, '__')) "
       "SELECT image_path, count(DISTINCT split) AS n_splits FROM m GROUP BY image_path HAVING count(DISTINCT split) > 1")
def split_overlap(spark, folder):
    """A correct split with every forty-ninth row moved to test: the overlaps that creates."""
    s = pk.split_by_group(si.samples(spark, folder, messages=False))
    return pk.split_overlap(s.withColumn("split", F.when(F.col("seq") % 49 == 0, F.lit("test")).otherwise(F.col("split"))))


@query("stratified_split", "W4", f"""WITH {si.SAMPLES}, r AS (SELECT id, intent, image_type, row_number() OVER (PARTITION BY intent, image_type ORDER BY md5('42|' || id), id) AS rn, count(*) OVER (PARTITION BY intent, image_type) AS n FROM samples),
 c AS (SELECT *, CASE WHEN n >= 5 THEN greatest(1, n // 10) ELSE 0 END AS k FROM r)
SELECT id, intent, image_type, CASE WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'val' ELSE 'train' END AS split FROM c""")
def stratified_split(spark, folder):
    s = si.samples(spark, folder, messages=False).select("id", "intent", "image_type")
    return pk.stratified_split(s)


@query("stratified_sample", "W2", f"""WITH {si.SAMPLES}, q AS (SELECT difficulty, greatest(1, round_even(200 * count(*) / (SELECT count(*) FROM samples), 0)) AS quota FROM samples GROUP BY difficulty),
 r AS (SELECT id, s.difficulty, md5('42|' || id) AS h, quota, row_number() OVER (PARTITION BY s.difficulty ORDER BY md5('42|' || id), id) AS rn FROM samples s JOIN q USING (difficulty))
SELECT id, difficulty FROM r WHERE rn <= quota ORDER BY h, id LIMIT 200""")
def stratified_sample(spark, folder):
    return pk.stratified_sample(si.samples(spark, folder, messages=False).select("id", "difficulty"), 200)


@query("load_suite", "S7", "SELECT item_id, text FROM benchmark ORDER BY md5('42|' || CAST(item_id AS VARCHAR)), item_id LIMIT 25")
def load_suite(spark, folder):
    return pk.load_suite(table(spark, folder, "benchmark"), 25, "item_id")


# ---- plan ----

_CELLS = "cells AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', '{t}', {n})" for i, row in lx.TARGET_MATRIX.items() for t, n in row.items()) + ") AS v(intent, image_type, target))"
_INTENT_SQL = "[" + ", ".join(f"'{k}'" for k, _ in lx.INTENTS) + "]"
_TYPE_SQL = "[" + ", ".join(f"'{k}'" for k, _, _ in lx.IMAGE_TYPES) + "]"
# documents dealt onto the taxonomy so that plan queries measure real counts
_DEALT = f"dealt AS (SELECT doc_id, {_INTENT_SQL}[doc_id % 7 + 1] AS intent, {_TYPE_SQL}[(doc_id // 7) % 6 + 1] AS image_type FROM documents)"


def _dealt(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    names = F.array(*[F.lit(k) for k, _ in lx.INTENTS])
    types = F.array(*[F.lit(k) for k, _, _ in lx.IMAGE_TYPES])
    return d.select("doc_id", F.get(names, (i % 7).cast("int")).alias("intent"), F.get(types, F.pmod(F.floor(i / 7), F.lit(6)).cast("int")).alias("image_type"))


@query("target_vs_actual", "J10 S13", f"""WITH {_CELLS}, {_DEALT}, h AS (SELECT intent, image_type, count(*) AS actual FROM dealt GROUP BY ALL)
SELECT intent, image_type, coalesce(target, 0)::BIGINT AS target, coalesce(actual, 0) AS actual, coalesce(target, 0)::BIGINT - coalesce(actual, 0) AS gap FROM cells FULL JOIN h USING (intent, image_type)""")
def target_vs_actual(spark, folder):
    return pk.target_vs_actual(sc.target_cells(spark), _dealt(spark, folder))


@query("matrix_gaps", "L7 S13", f"""WITH {_CELLS}, {_DEALT}, r AS (SELECT DISTINCT intent, image_type FROM cells WHERE target > 0), p AS (SELECT DISTINCT intent, image_type FROM dealt)
SELECT *, 'missing' AS problem FROM (SELECT * FROM r EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'stray' FROM (SELECT * FROM p EXCEPT SELECT * FROM r)""")
def matrix_gaps(spark, folder):
    return pk.matrix_gaps(sc.target_cells(spark).filter("target > 0"), _dealt(spark, folder), ["intent", "image_type"])


@query("target_matrix", "A6", f"WITH {_DEALT}, n AS (SELECT intent, image_type, count(*) AS target FROM dealt GROUP BY ALL) SELECT intent, image_type, CAST(sum(target) AS BIGINT) AS target FROM n GROUP BY CUBE (intent, image_type)")
def target_matrix(spark, folder):
    n = _dealt(spark, folder).groupBy("intent", "image_type").agg(F.count(F.lit(1)).alias("target"))
    return pk.target_matrix(n)


_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in lx.INTENTS) + ") AS v(intent, intent_name)), kinds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{n}', {d})" for k, n, d in lx.IMAGE_TYPES) + ") AS v(image_type, image_type_name, difficulty))"


@query("priority_plan", "W6 J8", f"""WITH {_DEALT}, {_NAMES}, n AS (SELECT intent, image_type, count(*)::INTEGER AS target FROM dealt GROUP BY ALL)
SELECT row_number() OVER (ORDER BY target DESC, intent, image_type)::INTEGER AS priority, intent, intent_name, image_type, image_type_name, target AS count, difficulty FROM n JOIN names USING (intent) JOIN kinds USING (image_type)""")
def priority_plan(spark, folder):
    n = _dealt(spark, folder).groupBy("intent", "image_type").agg(F.count(F.lit(1)).cast("int").alias("target"))
    return pk.priority_plan(n, sc.intents(spark), sc.image_types(spark))


_TAG = "CAST('0x' || substr(md5('{seed}|' || tag), 1, 8) AS BIGINT)"
_NAMES, _MOODS = si.sql_list([n for n, _ in lx.PERSONAS]), si.sql_list(lx.EMOTIONS)


@query("expand_plan", "J9 W6", f"""WITH {_DEALT}, cells AS (SELECT intent, image_type, count(*) AS c FROM dealt GROUP BY ALL),
 pool AS (SELECT image_type, p, row_number() OVER (PARTITION BY image_type ORDER BY md5('42|' || image_type || '|' || p), p) - 1 AS idx, count(*) OVER (PARTITION BY image_type) AS size
   FROM (SELECT DISTINCT image_type, 'img/' || doc_id AS p FROM dealt WHERE image_type <> 'size_chart')),
 prods AS (SELECT p_name, row_number() OVER (ORDER BY md5('42|' || p_name), p_name) - 1 AS pidx, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)),
 long AS (SELECT intent, image_type, c, i, intent || '|' || image_type || '|' || i AS tag FROM (SELECT *, unnest(range(1, c + 1)) AS i FROM cells)),
 r AS (SELECT *, row_number() OVER (PARTITION BY intent, image_type ORDER BY md5('42|' || tag)) AS rn FROM long)
SELECT r.intent, r.image_type, CAST(i AS INTEGER) AS i, CASE WHEN rn <= floor(c * 0.06) THEN 'clarify' WHEN rn <= floor(c * 0.06) + floor(c * 0.04) THEN 'escalate' ELSE 'normal' END AS kind, pool.p AS image_path, p_name AS product,
  ({_NAMES})[{_TAG.format(seed=45)} % len({_NAMES}) + 1] AS persona, ({_MOODS})[{_TAG.format(seed=46)} % len({_MOODS}) + 1] AS emotion
FROM r JOIN (SELECT DISTINCT image_type, size FROM pool) z ON z.image_type = r.image_type JOIN pool ON pool.image_type = r.image_type AND pool.idx = {_TAG.format(seed=43)} % z.size
JOIN prods ON prods.pidx = {_TAG.format(seed=44)} % prods.n""")
def expand_plan(spark, folder):
    """Every row with its kind and picks."""
    d = _dealt(spark, folder)
    plan = d.groupBy("intent", "image_type").agg(F.count(F.lit(1)).cast("int").alias("count"))
    images = d.filter("image_type <> 'size_chart'").select("image_type", F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("image_path"))
    products = table(spark, folder, "part").select(F.col("p_name").alias("product"))
    return pk.expand_plan(plan, images, products)[0]


@query("resume_anti", "J7", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, folder):
    return pk.resume_anti(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id").select("doc_id", "source")


@query("drop_missing_images", "F11", """SELECT doc_id FROM documents d WHERE d.doc_id % 9 = 0 OR ('img/' || CAST(doc_id AS VARCHAR) IN (SELECT 'img/' || CAST(page_id AS VARCHAR) FROM pages)
  AND 'img/' || CAST(doc_id // 2 AS VARCHAR) IN (SELECT 'img/' || CAST(page_id AS VARCHAR) FROM pages))""")
def drop_missing_images(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    name = lambda c: F.concat(F.lit("img/"), c.cast("string"))
    rows = d.select("doc_id", F.when(i % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(name(i), name(F.floor(i / 2)))).alias("images"))
    return pk.drop_missing_images(rows, table(spark, folder, "pages").select(name(F.col("page_id")).alias("path")), "doc_id").select("doc_id")


@query("dataset_card", "A5", f"""WITH {si.SAMPLES}, t AS (SELECT count(*) AS total FROM samples), l AS (SELECT 'intent' AS dim, intent AS value, count(*) AS n FROM samples GROUP BY intent UNION ALL SELECT 'image_type', image_type, count(*) FROM samples GROUP BY image_type)
SELECT 'thin_' || dim AS issue, value, n, round(n / total, 6) AS share FROM l, t WHERE n / total < 0.05
UNION ALL SELECT 'easy_bias', '1-2', count(*), round(count(*) / any_value(total), 6) FROM samples, t WHERE difficulty <= 2 HAVING count(*) / any_value(total) > 0.3
UNION ALL SELECT 'leakage', 'image', 7, NULL""")
def dataset_card(spark, folder):
    s = si.samples(spark, folder, messages=False)
    return pk.dataset_card(s, n_leaks=7, easy=0.3).withColumn("share", F.round("share", 6))


_MIX = ", ".join(f"('{k}', {v})" for k, v in lx.TARGET_MIX.items())


@query("mix_report", "A39", f"""WITH f AS (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'refusal' WHEN source = 'src2' THEN 'hard' WHEN lang = 'en' THEN 'domain' WHEN lang = 'fr' THEN 'general' ELSE 'other' END AS family FROM documents),
 h AS (SELECT family, count(*) AS n FROM f GROUP BY family), t AS (SELECT * FROM (VALUES {_MIX}) AS v(family, target))
SELECT family, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM f), 6) AS share, target::DOUBLE AS target, round(coalesce(n, 0) / (SELECT count(*) FROM f) - coalesce(target, 0), 6) AS gap FROM t FULL JOIN h USING (family)""")
def mix_report(spark, folder):
    d = table(spark, folder, "documents")
    fam = (F.when(F.col("source").isin("src0", "src1"), F.lit("refusal")).when(F.col("source") == "src2", F.lit("hard")).when(F.col("lang") == "en", F.lit("domain"))
           .when(F.col("lang") == "fr", F.lit("general")).otherwise(F.lit("other")))
    targets = spark.createDataFrame(list(lx.TARGET_MIX.items()), "family string, target double")
    return pk.mix_report(d, fam, targets).withColumns({"share": F.round("share", 6), "gap": F.round("gap", 6)})


@query("recent_context", "P11", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6")
def recent_context(spark, folder):
    return pk.recent_context(table(spark, folder, "conversations")).select("conv_id", "turn", "role")


# ---- preference pairs ----

_PAIRS = """dialogue_pairs AS (SELECT CAST(conv_id AS VARCHAR) AS id, trim(user_text) AS prompt, trim(reply_text) AS chosen, trim(user_text) AS rejected, ['img/' || conv_id] AS images, 'dialogue' AS source FROM dialogues),
 doc_pairs AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, '.', 1) AS prompt, text AS chosen, CASE WHEN doc_id % 13 = 0 THEN text WHEN doc_id % 17 = 0 THEN '  ' ELSE split_part(text, chr(10), 1) END AS rejected,
   CASE WHEN doc_id % 4 = 0 THEN []::VARCHAR[] ELSE ['/abs/' || doc_id] END AS images, source FROM documents),
 pairs AS (SELECT 'dialogue' AS file, id, prompt, chosen, rejected, list_transform(images, lambda i: '/root/' || i) AS images, source FROM dialogue_pairs WHERE chosen IS NOT NULL AND rejected IS NOT NULL AND chosen <> rejected
   UNION ALL SELECT 'docs', id, trim(prompt, ' ' || chr(10) || chr(9)), chosen, trim(rejected), images, source FROM doc_pairs WHERE trim(rejected) <> '' AND chosen <> trim(rejected))"""


def _pairs(spark, folder):
    d = si.dialogues(spark, folder)
    i = F.col("conv_id").cast("string")
    a = d.select(i.alias("id"), F.col("user_text").alias("query"), F.col("reply_text").alias("chosen"), F.col("user_text").alias("rejected"), F.concat(F.lit("img/"), i).alias("image"))
    doc = table(spark, folder, "documents")
    k = F.col("doc_id")
    b = doc.select(k.cast("string").alias("id"), F.substring_index("text", ".", 1).alias("prompt"), F.col("text").alias("chosen"),
                   F.when(k % 13 == 0, F.col("text")).when(k % 17 == 0, F.lit("  ")).otherwise(F.substring_index("text", "\n", 1)).alias("rejected"),
                   F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/abs/"), k.cast("string")))).alias("images"), "source")
    return pr.union_pairs({"dialogue": a, "docs": b}, image_root="/root")


@query("union_pairs", "S10 F12 L3", f"WITH {si.DIALOGUES}, {_PAIRS} SELECT file, id, prompt, chosen, rejected, array_to_string(images, ',') AS images, source FROM pairs")
def union_pairs(spark, folder):
    p = _pairs(spark, folder)
    return p.select("file", "id", "prompt", "chosen", "rejected", F.array_join("images", ",").alias("images"), "source")


@query("pair_counts", "S10", f"WITH {si.DIALOGUES}, {_PAIRS} SELECT file, source, count(*) AS n FROM pairs GROUP BY ALL")
def pair_counts(spark, folder):
    return pr.pair_counts(_pairs(spark, folder))


@query("mix_sources", "L3", f"""WITH {si.DIALOGUES}, {_PAIRS} SELECT file, id FROM pairs WHERE CASE source WHEN 'dialogue' THEN CAST('0x' || substr(md5('42|' || source || '|' || id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5
  WHEN 'src1' THEN CAST('0x' || substr(md5('42|' || source || '|' || id), 1, 8) AS BIGINT) / 4294967296.0 < 0.25 ELSE true END""")
def mix_sources(spark, folder):
    return pr.mix_sources(_pairs(spark, folder), {"dialogue": 0.5, "src1": 0.25}).select("file", "id")


@query("pair_length_ratio", "F13", f"WITH {si.DIALOGUES}, {_PAIRS} SELECT file, id FROM pairs WHERE greatest(length(chosen), length(rejected)) / least(length(chosen), length(rejected)) <= 4.0")
def pair_length_ratio(spark, folder):
    return pr.drop_uneven(_pairs(spark, folder)).select("file", "id")


@query("pair_issues", "A27 F11", f"""WITH {si.DIALOGUES}, {_PAIRS}, l AS (SELECT '/abs/' || page_id AS path FROM pages)
SELECT '缺图片路径' AS issue, count(*) FILTER (WHERE len(images) = 0) AS n FROM pairs UNION ALL SELECT 'prompt 为空', count(*) FILTER (WHERE prompt = '') FROM pairs
UNION ALL SELECT 'chosen 比 rejected 短很多', count(*) FILTER (WHERE length(chosen) * 3 < length(rejected)) FROM pairs
UNION ALL SELECT 'rejected 明显像套话', count(*) FILTER (WHERE contains(substr(rejected, 1, 20), 'Th') AND length(rejected) < 40) FROM pairs
UNION ALL SELECT '图片文件不存在', count(DISTINCT id) FROM (SELECT id, unnest(images) AS path FROM pairs) WHERE path NOT IN (SELECT path FROM l)""")
def pair_issues(spark, folder):
    listing = table(spark, folder, "pages").select(F.concat(F.lit("/abs/"), F.col("page_id").cast("string")).alias("path"))
    return pr.pair_issues(_pairs(spark, folder), listing, ("Th",))


@query("pair_stats", "A28", f"""WITH {si.DIALOGUES}, {_PAIRS}, l AS (SELECT 'prompt' AS side, length(prompt) AS n FROM pairs UNION ALL SELECT 'chosen', length(chosen) FROM pairs UNION ALL SELECT 'rejected', length(rejected) FROM pairs),
 r AS (SELECT side, n, row_number() OVER (PARTITION BY side ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY side) AS c FROM l),
 x AS (SELECT count(*) FILTER (WHERE length(chosen) > length(rejected)) / count(*) AS share FROM pairs)
SELECT side, max(n) FILTER (WHERE i = least(CAST(floor(c * 0.5) AS BIGINT), c - 1))::DOUBLE AS p50, max(n) FILTER (WHERE i = least(CAST(floor(c * 0.9) AS BIGINT), c - 1))::DOUBLE AS p90,
  max(n) FILTER (WHERE i = least(CAST(floor(c * 0.99) AS BIGINT), c - 1))::DOUBLE AS p99, max(n)::INTEGER AS max, round(any_value(share), 6) AS chosen_longer, any_value(share) > 0.75 OR any_value(share) < 0.25 AS imbalanced FROM r, x GROUP BY side""")
def pair_stats(spark, folder):
    return pr.pair_stats(_pairs(spark, folder)).withColumn("chosen_longer", F.round("chosen_longer", 6))


_PICK = "CAST('0x' || substr(md5('{seed}|' || id), 1, 8) AS BIGINT)"


@query("contrastive_pairs", "J13", f"""WITH {si.SAMPLES}, u AS (SELECT seq, id, image_type, image_path || '#' || id AS p, reply_text FROM samples WHERE image_path IS NOT NULL),
 pool AS (SELECT image_type, p, row_number() OVER (PARTITION BY image_type ORDER BY md5('42|' || image_type || '|' || p), p) - 1 AS idx, count(*) OVER (PARTITION BY image_type) AS size FROM (SELECT DISTINCT image_type, p FROM u)),
 types AS (SELECT image_type, row_number() OVER (ORDER BY image_type) - 1 AS t, any_value(size) AS size FROM pool GROUP BY image_type), nt AS (SELECT count(*) AS k FROM types),
 r AS (SELECT u.id, u.image_type, (own.t + 1 + {_PICK.format(seed=43)} % greatest(k - 1, 1)) % k AS t FROM u JOIN types own USING (image_type), nt WHERE reply_text IS NOT NULL AND k >= 2)
SELECT id, r.image_type AS own_type, o.image_type AS other_type, pool.p AS rejected_image FROM r JOIN types o ON o.t = r.t JOIN pool ON pool.image_type = o.image_type AND pool.idx = {_PICK.format(seed=44)} % o.size""")
def contrastive_pairs(spark, folder):
    """The picks themselves: which image of which other type stands against a row's own."""
    s = si.samples(spark, folder, messages=False).withColumn("image_path", F.when(F.col("image_path").isNotNull(), F.concat_ws("#", "image_path", "id")))
    p = pr.contrastive_pairs(s.select("seq", "id", "image_type", "image_path", F.col("user_text").alias("query"), F.col("reply_text").alias("answer")))
    return p.select(F.regexp_replace("id", "contrast_", "").alias("id"), F.col("image_type").alias("own_type"), "other_type", F.get("rejected_images", F.lit(0)).alias("rejected_image"))


_LOGPS = "logps AS (SELECT l_returnflag AS g, l_extendedprice / -1000 AS pc, l_quantity * -1.5 AS pr, l_extendedprice / -1100 AS rc, l_quantity * -1.4 AS rr FROM lineitem)"


@query("dpo_metrics", "X27", f"""WITH {_LOGPS}, d AS (SELECT g, 0.1 * (pc - rc) AS c, 0.1 * (pr - rr) AS r FROM logps)
SELECT g, round(avg(greatest(-(c - r), 0) + ln(1 + exp(-abs(c - r)))), 6) AS loss, round(avg((c > r)::INT), 6) AS accuracy, round(avg(c), 6) AS rewards_chosen, round(avg(r), 6) AS rewards_rejected, round(avg(c - r), 6) AS reward_margin FROM d GROUP BY g""")
def dpo_metrics(spark, folder):
    li = table(spark, folder, "lineitem")
    lp = li.select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / -1000).alias("pc"), (F.col("l_quantity") * -1.5).alias("pr"),
                   (F.col("l_extendedprice") / -1100).alias("rc"), (F.col("l_quantity") * -1.4).alias("rr"))
    m = pr.dpo_metrics(lp, ["g"])
    return m.select("g", *[F.round(c, 6).alias(c) for c in m.columns if c != "g"])


@query("group_advantage", "A35", """WITH s AS (SELECT l_suppkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN d > 1e-12 THEN (l_quantity - m) / d ELSE 0.0 END, 6) AS advantage FROM lineitem JOIN s USING (l_suppkey)""")
def group_advantage(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return pr.group_advantage(li, "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", F.round("advantage", 6).alias("advantage"))
