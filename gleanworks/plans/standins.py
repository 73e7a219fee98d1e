"""Views of the given tables in the shape the operators expect, each with the same view as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules as ru, vision as vi
from ..operators import evaluation as ev
from .registry import table

# The given texts are invented prose in four European languages: same rules, other lists and bounds.
CONFIG = ru.CleanConfig(user=(4, 6000), reply=(20, 4000), script="a-zA-Z", min_script=0.6,
                        banned=("Licensed under", "Released under", "All rights reserved", "token ="))
REFUSALS = ("erin that", "les que", "ung die", "los que", "that was")
PROMISES = ("the was", "et qui", "von das", "por los", "with this")
MUST = {"en": ("the and", "of the", "that"), "fr": ("que le", "la de"), "de": ("und der", "die"), "es": ("que", "de la")}
MUST_NOT = ("%%%", "&&&")
GROUPS = {"licence": ("License", "licensed"), "contact": ("@", "+1 ("), "noise": ("***", "$$$"), "article": ("the ", " la ")}
YES, NO = ("The", "Le", "Die", "La"), ("Of", "De", "Und", "Que")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


# ---- dialogues: first user and first assistant turn ----

DIALOGUES = """dialogues AS (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text,
         arg_min(text, turn) FILTER (WHERE role = 'assistant') AS reply_text
  FROM conversations GROUP BY conv_id)"""


def dialogues(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")

    def first(role: str):
        mine = F.col("role") == role
        return F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn"))).alias("user_text" if role == "user" else "reply_text")

    return c.groupBy("conv_id").agg(first("user"), first("assistant"))


# ---- samples: one (image, question, reply) row per document ----

SAMPLES = """samples AS (
  SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS id, text, text AS user_text,
         CASE WHEN doc_id % 37 = 0 THEN NULL ELSE text END AS reply_text, lang AS intent, source AS image_type,
         CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN '__no_image__'
              ELSE 'img/' || CAST(doc_id // 3 AS VARCHAR) || '.jpg' END AS image_path,
         CAST(doc_id % 5 + 1 AS INTEGER) AS difficulty, n_chars FROM documents)"""


def samples(spark: SparkSession, folder: str, messages: bool = True) -> DataFrame:
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    path = (F.when(i % 41 == 0, F.lit(None)).when(i % 10 == 0, F.lit("__no_image__"))
            .otherwise(F.concat(F.lit("img/"), F.floor(i / 3).cast("string"), F.lit(".jpg"))))
    df = d.select(i.alias("seq"), i.cast("string").alias("id"), "text", F.col("text").alias("user_text"),
                  F.when(i % 37 != 0, F.col("text")).alias("reply_text"), F.col("lang").alias("intent"), F.col("source").alias("image_type"),
                  path.alias("image_path"), (i % 5 + 1).cast("int").alias("difficulty"), "n_chars")
    if not messages:
        return df
    none = F.lit(None).cast("string")
    part = lambda kind, text, p: F.struct(F.lit(kind).alias("type"), text.alias("text"), p.alias("path"))
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", none, F.col("image_path")), part("text", F.col("user_text"), none)).alias("content"))
    reply = F.struct(F.lit("assistant").alias("role"), F.array(part("text", F.col("reply_text"), none)).alias("content"))
    return df.withColumn("messages", F.when(F.col("reply_text").isNull(), F.array(user)).otherwise(F.array(user, reply)))


# ---- image sizes: one stand-in image per page ----

def page_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", (F.length("html") % 3000 + 20).alias("w"), (F.length("url") * 37 % 2000 + 20).alias("h"))


CONTACT_SQL = r"""(regexp_matches({t}, '\d{{11}}') OR regexp_matches({t}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+')
   OR regexp_matches({t}, '(微信|QQ|vx|VX|wx)\s*[:：]?\s*[\p{{L}}\p{{M}}\p{{Nd}}_]+') OR regexp_matches({t}, 'https?://'))"""
HALF_SQL = "(length({t}) > 40 AND substr({t}, 1, length({t}) // 2) = substr({t}, length({t}) // 2 + 1, length({t}) // 2))"
RULE_REASON_SQL = f"""CASE WHEN user_text IS NULL OR reply_text IS NULL THEN '结构异常'
  WHEN length(user_text) NOT BETWEEN 4 AND 6000 THEN '用户提问长度越界(' || length(user_text) || ')'
  WHEN length(reply_text) NOT BETWEEN 20 AND 4000 THEN '回复长度越界(' || length(reply_text) || ')'
  WHEN length(regexp_replace(user_text || reply_text, '[^a-zA-Z]', '', 'g')) / greatest(length(user_text || reply_text), 1) < 0.6 THEN '中文占比过低'
  WHEN {CONTACT_SQL.format(t="(user_text || reply_text)")} THEN '含联系方式'
  {" ".join(f"WHEN contains(reply_text, '{w}') THEN '含AI自我暴露({w})'" for w in CONFIG.banned)}
  WHEN {HALF_SQL.format(t="reply_text")} THEN '回复自我重复' END"""
FORMAT_REASON_SQL = """CASE WHEN reply_text IS NULL THEN '结构异常' WHEN image_path IS NULL OR image_path = '' THEN '缺少图片路径' END"""

# rows with format and rule reasons, then literal duplicates of the whole question on what is left (text decides: no hashes)
STAGED = f"""{SAMPLES},
checked AS (SELECT *, {FORMAT_REASON_SQL} AS f_reason, {RULE_REASON_SQL} AS r_reason FROM samples),
staged AS (SELECT *, CASE WHEN f_reason IS NOT NULL THEN 'format' WHEN r_reason IS NOT NULL THEN 'rules'
    WHEN row_number() OVER (PARTITION BY (f_reason IS NULL AND r_reason IS NULL), trim(user_text) ORDER BY seq) > 1 THEN 'dedup' END AS dropped_at,
  coalesce(f_reason, r_reason) AS early_reason FROM checked),
stages AS (SELECT *, CASE WHEN dropped_at = 'dedup' THEN '图+文整体重复' ELSE early_reason END AS reason FROM staged)"""


# ---- fingerprints of whole texts ----

def _gram(consts, prime):
    return "(" + " + ".join(f"c{k} * {a}::BIGINT" for k, a in enumerate(consts)) + f") % {prime}"


_BITS = " + ".join(
    f"(CASE WHEN sum(({h} >> {31 - b}) & 1) * 2 > count(*) THEN {1 << (63 - off - b)}::HUGEINT ELSE 0::HUGEINT END)"
    for h, off in (("hi", 0), ("lo", 32)) for b in range(32))
FINGERPRINTS = f"""chars AS (
  SELECT doc_id, unicode(unnest(string_split(text, ''))) AS c0, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
grams AS (
  SELECT DISTINCT doc_id, {_gram(vi.A_HI, vi.P_HI)} AS hi, {_gram(vi.A_LO, vi.P_LO)} AS lo FROM (
    SELECT doc_id, c0::BIGINT AS c0, lead(c0, 1) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3, lead(c0, 4) OVER w AS c4
    FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE c4 IS NOT NULL),
raw_prints AS (SELECT doc_id, {_BITS} AS v FROM grams GROUP BY doc_id),
prints AS (SELECT doc_id, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS phash FROM raw_prints)"""


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", vi.simhash64("text").alias("phash"))


# ---- evaluation records ----

_PII_SQL = r"""(regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])') OR regexp_matches(text, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])')
   OR regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') OR regexp_matches(text, '(^|[^0-9])[0-9]{16,19}($|[^0-9])'))"""
_MUST_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in MUST.items()) + " END"
RECORDS = f"""base AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, 'run_' || CAST(d.doc_id % 3 AS VARCHAR) AS tag, 'L' || CAST((d.doc_id // 3) % 4 + 1 AS VARCHAR) AS tier,
    CASE WHEN d.doc_id % 53 = 0 THEN '未知' ELSE lang END AS intent, source AS image_type, split_part(text, '.', 1) AS query, text, d.n_chars * 0.125 + d.doc_id % 700 AS latency_ms,
    CASE WHEN d.doc_id % 29 = 0 THEN 'timeout' ELSE '' END AS error,
    CASE WHEN l.doc_id IS NOT NULL THEN 1.0 + 3 * quality END AS judge_acc,
    CASE WHEN l.doc_id IS NOT NULL THEN ((1.0 + 3 * quality) + (5.0 - 2 * toxic) + (3.0 + quality)) / 3 END AS judge,
    {_MUST_SQL} AS must, {sql_list(MUST_NOT)} AS forbid, d.doc_id % 7 = 0 AS refuse, CASE WHEN d.doc_id % 5 = 0 THEN 'tion' END AS want_intent
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
flags AS (
  SELECT *, len(list_filter(must, lambda k: contains(text, k))) AS hits, NOT {sql_any("text", MUST_NOT)} AS mn_ok, {sql_any("text", REFUSALS)} = refuse AS rf_ok,
    NOT {sql_any("text", PROMISES)} AS op_ok, NOT {_PII_SQL} AS pii_ok, contains(text, 'tion') AS in_ok, want_intent IS NOT NULL AS in_app FROM base),
records AS (
  SELECT *, hits > 0 AS mc_ok, hits > 0 AND mn_ok AND rf_ok AND op_ok AND pii_ok AND (NOT in_app OR in_ok) AS passed,
    (least(1.0, hits * 2.0 / len(must)) + mn_ok::INT + rf_ok::INT + op_ok::INT + pii_ok::INT + CASE WHEN in_app THEN in_ok::INT ELSE 0 END)
      / (5 + in_app::INT) AS score,
    error <> '' AS is_error FROM flags),
judged AS (SELECT *, is_error OR NOT passed OR coalesce(judge < 3, false) AS failed FROM records)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    """EVAL_RECORD rows judged by the rules."""
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    i = F.col("doc_id")
    j = d.join(lab, "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    judge = F.when(q.isNotNull(), F.create_map(F.lit("accuracy"), 1.0 + 3 * q, F.lit("helpfulness"), 5.0 - 2 * t, F.lit("tone"), 3.0 + q))
    must = F.coalesce(*[F.when(F.col("lang") == k, F.array(*[F.lit(w) for w in v])) for k, v in MUST.items()])
    df = j.select(
        F.concat(F.lit("run_"), (i % 3).cast("string")).alias("tag"), i.cast("string").alias("id"),
        F.concat(F.lit("L"), (F.pmod(F.floor(i / 3), F.lit(4)) + 1).cast("string")).alias("difficulty"),
        F.when(i % 53 != 0, F.col("lang")).alias("intent"), F.col("source").alias("image_type"), F.substring_index("text", ".", 1).alias("query"),
        F.array(F.concat(F.lit("img/"), i.cast("string"))).alias("images"), F.col("text").alias("model_answer"),
        (F.col("n_chars") * 0.125 + i % 700).cast("double").alias("latency_ms"), F.when(i % 29 == 0, F.lit("timeout")).otherwise(F.lit("")).alias("error"),
        judge.alias("judge"), must.alias("must_contain"), F.array(*[F.lit(w) for w in MUST_NOT]).alias("must_not_contain"), (i % 7 == 0).alias("should_refuse"),
        F.when(i % 5 == 0, F.lit("tion")).alias("expected_intent"), F.when(i % 4 != 0, F.concat(F.lit("ref: "), F.substring("text", 1, 40))).alias("reference"))
    return ev.judge_answers(df, REFUSALS, PROMISES)


# ---- traces and calls from the event log ----

STEPS = """steps AS (
  SELECT user_id AS session_id, event_id AS seq, ts, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS turn,
    CASE event_type WHEN 'purchase' THEN 'tool' WHEN 'signup' THEN 'guard' ELSE 'model' END AS kind, event_type AS name, value AS ms, event_type <> 'error' AS ok,
    k * 10 AS in_tokens, k AS out_tokens, value / 10000 AS cost,
    CASE WHEN event_type = 'signup' THEN CASE k % 4 WHEN 1 THEN 'abort' WHEN 2 THEN 'escalate' ELSE 'continue' END END AS action,
    event_type || '|' || CAST(k % 3 AS VARCHAR) AS action_key
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    act = F.when(F.col("k") % 4 == 1, F.lit("abort")).when(F.col("k") % 4 == 2, F.lit("escalate")).otherwise(F.lit("continue"))
    kind = F.when(F.col("event_type") == "purchase", F.lit("tool")).when(F.col("event_type") == "signup", F.lit("guard")).otherwise(F.lit("model"))
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("idx"), "ts",
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("turn"), kind.alias("kind"), F.col("event_type").alias("name"),
        F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"), (F.col("k") * 10).alias("in_tokens"), F.col("k").alias("out_tokens"),
        (F.col("value") / 10000).alias("cost"),
        F.when(F.col("event_type") == "signup", F.create_map(F.lit("action"), act)).otherwise(F.create_map().cast("map<string,string>")).alias("detail"),
        F.concat_ws("|", "event_type", (F.col("k") % 3).cast("string")).alias("action_key"), (kind == "tool").alias("is_tool"), (F.col("k") * 11).alias("tokens"))


# ---- shop side ----

PLANS = {"free": (0.0, 5, 0.0), "standard": (99.0, 10, 0.15), "pro": (399.0, 20, 0.10)}
USAGE = """usage_events AS (
  SELECT event_id AS seq, 'u' || CAST(user_id AS VARCHAR) AS shop, strftime(ts, '%Y-%m') AS period,
    CAST(user_id AS VARCHAR) || '|' || regexp_extract(props, '[0-9]+') AS key, CAST((user_id % 13 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) / 4.0 AS DECIMAL(10,4)) AS amount, ts FROM events),
subs AS (
  SELECT 'u' || CAST(c_custkey AS VARCHAR) AS shop, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'free' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'pro' ELSE 'standard' END AS plan,
    CASE WHEN c_nationkey % 6 = 0 THEN 'frozen' ELSE 'active' END AS status, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'sub' || CAST(c_custkey AS VARCHAR) END AS subscription_id,
    CAST(CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 10, 2) ELSE 0 END AS DECIMAL(10,4)) AS capped_amount FROM customer)"""


def amount_column():
    """One charge per key: the same key always carries the same amount."""
    return ((F.col("user_id") % 13 + F.regexp_extract("props", "[0-9]+", 0).cast("long")) / 4.0).cast("decimal(10,4)")


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("shop"), F.date_format("ts", "yyyy-MM").alias("period"),
                    F.concat_ws("|", F.col("user_id").cast("string"), F.regexp_extract("props", "[0-9]+", 0)).alias("key"), amount_column().alias("amount"), "ts")


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    seg = F.col("c_mktsegment")
    plan = F.when(seg.isin("BUILDING", "MACHINERY"), F.lit("free")).when(seg == "HOUSEHOLD", F.lit("pro")).otherwise(F.lit("standard"))
    cap = F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") / 10, 2)).otherwise(0.0).cast("decimal(10,4)")
    return c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("shop"), plan.alias("plan"),
                    F.when(F.col("c_nationkey") % 6 == 0, F.lit("frozen")).otherwise(F.lit("active")).alias("status"),
                    F.when(F.col("c_nationkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("sub"), F.col("c_custkey").cast("string"))).alias("subscription_id"), cap.alias("capped_amount"))


# ---- orders ----

AS_OF = "2001-06-30"
ORDERS = """shop_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS session_id, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS ordered,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'pending' END AS status, 'c' || CAST(o_custkey % 7 AS VARCHAR) AS carrier,
    't' || CAST(o_orderkey AS VARCHAR) AS tracking, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 5 END AS delivered_at FROM orders)"""


def shop_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    s = F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("session_id"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("ordered"),
                    F.when(s == "F", F.lit("delivered")).when(s == "O", F.lit("shipped")).otherwise(F.lit("pending")).alias("status"),
                    F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("carrier"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tracking"),
                    F.when(s == "F", F.date_add(F.to_date("o_orderdate"), 5)).alias("delivered_at"))
