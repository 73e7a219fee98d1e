"""Queries: row shape, rule filters, stages and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import rules as ru, text as tx, vision as vi
from ..operators import dedup, simjoin, stages as st
from ..ordering import first_wins
from ..operators import packing as pk
from ..session import cut_lineage
from . import standins as si
from .registry import query, table


@query("stage_waterfall", "S1 A2 U7 F7", f"""WITH {si.STAGED}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE dropped_at = 'format') AS f,
  count(*) FILTER (WHERE dropped_at = 'rules') AS r, count(*) FILTER (WHERE dropped_at = 'dedup') AS d FROM stages),
 w AS (SELECT 0 AS step, 'input' AS stage, n AS alive, n FROM c UNION ALL SELECT 1, 'format', n - f, n FROM c UNION ALL SELECT 2, 'rules', n - f - r, n FROM c
  UNION ALL SELECT 3, 'clip', n - f - r, n FROM c UNION ALL SELECT 4, 'dedup', n - f - r - d, n FROM c)
SELECT step, stage, alive, round(1 - alive / n, 6) AS lost FROM w""")
def stage_waterfall(spark, folder):
    done = st.run_stages(si.samples(spark, folder), cfg=si.CONFIG)
    return st.waterfall(done).withColumn("lost", F.round("lost", 6))


@query("rejection_report", "A1 F7", f"""WITH {si.STAGED}, g AS (SELECT *, split_part(reason, '(', 1) AS family, count(*) OVER () AS total FROM stages),
 k AS (SELECT family, seq, substr(user_text, 1, 60) AS ex, row_number() OVER (PARTITION BY family ORDER BY seq) AS rn FROM g WHERE dropped_at IS NOT NULL)
SELECT g.family, count(*) AS n, round(count(*) / any_value(total), 6) AS share,
  (SELECT string_agg(ex, ' || ' ORDER BY rn) FROM k WHERE k.family = g.family AND rn <= 3) AS examples FROM g WHERE dropped_at IS NOT NULL GROUP BY g.family""")
def rejection_report(spark, folder):
    done = st.run_stages(si.samples(spark, folder), cfg=si.CONFIG)
    return st.rejection_report(done, F.col("user_text")).withColumn("share", F.round("share", 6))


@query("rule_filter", "F1 F2 F3 F4 F5 F6 F7", f"WITH {si.SAMPLES} SELECT id, {si.RULE_REASON_SQL} AS reason, ({si.RULE_REASON_SQL}) IS NULL AS keep FROM samples")
def rule_filter(spark, folder):
    s = si.samples(spark, folder)
    r = ru.clean_reason(tx.first_text(F.col("messages"), 0), tx.first_text(F.col("messages"), 1), si.CONFIG)
    return s.select("id", r.alias("reason"), r.isNull().alias("keep"))


@query("check_format", "F1", f"WITH {si.SAMPLES} SELECT id, {si.FORMAT_REASON_SQL} AS reason FROM samples")
def check_format(spark, folder):
    return si.samples(spark, folder).select("id", ru.check_format(F.col("messages"), F.col("image_path")).alias("reason"))


@query("text_predicates", "F2 F3 F4 F5 F6 X24", f"""SELECT doc_id, length(text) BETWEEN 20 AND 2000 AS in_bounds,
  round(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(length(text), 1), 6) AS latin_share, {si.CONTACT_SQL.format(t='text')} AS contact,
  CASE {' '.join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in si.CONFIG.banned)} END AS banned, {si.HALF_SQL.format(t='text')} AS repeats,
  CASE WHEN length(text) > 90 THEN substr(replace(replace(text, chr(10), ' '), '|', '／'), 1, 90) || '…' ELSE replace(replace(text, chr(10), ' '), '|', '／') END AS cell
FROM documents""")
def text_predicates(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", ru.length_bounds(t, 20, 2000).alias("in_bounds"), F.round(tx.script_share(t, "a-zA-Z"), 6).alias("latin_share"), tx.has_contact(t).alias("contact"),
        tx.first_hit(t, si.CONFIG.banned).alias("banned"), tx.half_repeat(t).alias("repeats"), tx.cell(t).alias("cell"))


@query("first_texts", "P1", f"WITH {si.DIALOGUES} SELECT conv_id, user_text, reply_text FROM dialogues")
def first_texts(spark, folder):
    d = si.dialogues(spark, folder)
    part = lambda c: F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
                             F.struct(F.lit("text").alias("type"), F.col(c).alias("text")))
    m = d.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), part("user_text").alias("content")),
                                         F.struct(F.lit("assistant").alias("role"), part("reply_text").alias("content"))))
    return m.select("conv_id", tx.first_text(F.col("messages"), 0).alias("user_text"), tx.first_text(F.col("messages"), 1).alias("reply_text"))


@query("validate_synth", "F8", f"""WITH {si.DIALOGUES} SELECT conv_id, CASE WHEN user_text IS NULL OR trim(user_text) = '' THEN '缺少字段 user_query'
  WHEN reply_text IS NULL OR trim(reply_text) = '' THEN '缺少字段 assistant'
  WHEN length(trim(user_text)) NOT BETWEEN 4 AND 300 THEN '用户提问长度异常 (' || length(trim(user_text)) || ')'
  WHEN length(trim(reply_text)) NOT BETWEEN 25 AND 1500 THEN '客服回复长度异常 (' || length(trim(reply_text)) || ')'
  WHEN contains(reply_text, 'that was') THEN '命中模板化用语: that was' WHEN contains(reply_text, 'les que') THEN '命中模板化用语: les que'
  WHEN length(trim(reply_text)) / greatest(length(trim(user_text)), 1) > 6 THEN '回复/提问长度比异常' END AS reason FROM dialogues""")
def validate_synth(spark, folder):
    d = si.dialogues(spark, folder)
    return d.select("conv_id", ru.synth_reason(F.col("user_text"), F.col("reply_text"), ("that was", "les que"), (4, 300), (25, 1500), 6.0).alias("reason"))


@query("consistency_filter", "F9", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 c AS (SELECT vec_id, label, e, first_value(e) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM v),
 s AS (SELECT vec_id, list_dot_product(e, a) / ((sqrt(list_dot_product(e, e)) + 1e-9) * (sqrt(list_dot_product(a, a)) + 1e-9)) AS sim FROM c)
SELECT vec_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.15""")
def consistency_filter(spark, folder):
    e = table(spark, folder, "embeddings")
    anchor = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return st.consistency_filter(e.join(anchor, "label"), "embedding", "anchor").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("quality_gate", "F10 S14", "SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality >= 1")
def quality_gate(spark, folder):
    return st.quality_gate(table(spark, folder, "documents"), table(spark, folder, "labels"), 1, "doc_id").select("doc_id", "lang")


@query("mask_pii", "X5 X6", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(^|[^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})($|[^0-9])', '\1\2****\3\4', 'g'),
  '(^|[^0-9])([0-9]{6})[0-9]{8}([0-9]{4})($|[^0-9])', '\1\2********\3\4', 'g')) AS masked,
  trim(regexp_replace(text, '(^|[^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})($|[^0-9])', '\1\2****\3\4', 'g')) AS reply FROM documents""")
def mask_pii(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", tx.mask_pii(t).alias("masked"), tx.postprocess_reply(t).alias("reply"))


@query("distribution", "A3", """SELECT 'intent' AS dim, lang AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang
UNION ALL SELECT 'image_type', source, count(*), round(count(*) / (SELECT count(*) FROM documents), 6) FROM documents GROUP BY source""")
def distribution(spark, folder):
    s = si.samples(spark, folder, messages=False)
    parts = [st.distribution(s, c).select(F.lit(c).alias("dim"), "value", "n", F.round("share", 6).alias("share")) for c in ("intent", "image_type")]
    return parts[0].unionByName(parts[1])


@query("length_stats", "A4", f"""WITH {si.DIALOGUES}, l AS (SELECT 'user' AS side, length(user_text) AS n FROM dialogues UNION ALL SELECT 'assistant', length(reply_text) FROM dialogues)
SELECT side, round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, max(n)::BIGINT AS max FROM l WHERE n IS NOT NULL GROUP BY side""")
def length_stats(spark, folder):
    s = pk.length_stats(si.dialogues(spark, folder), {"user": "user_text", "assistant": "reply_text"})
    return s.select("side", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "max")


@query("document_length_stats", "A4", """SELECT lang AS side, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text)::DOUBLE, 0.5), 6) AS median,
  round(quantile_cont(length(text)::DOUBLE, 0.9), 6) AS p90, max(length(text))::BIGINT AS max FROM documents GROUP BY lang""")
def document_length_stats(spark, folder):
    from ..ordering import exact_quantiles
    d = table(spark, folder, "documents").select(F.col("lang").alias("side"), F.length("text").alias("n"))
    q = exact_quantiles(d, ["side"], "n", {"median": (0.5, "linear"), "p90": (0.9, "linear")})
    b = d.groupBy("side").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").cast("long").alias("max"))
    return b.join(q, "side").select("side", "mean", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "max")


@query("content_md5", "X22 P7", """SELECT doc_id, md5(text) AS content_md5, count(*) OVER (PARTITION BY md5(text)) AS copies,
  substr(md5(lang || '|' || source || '|' || CAST(doc_id AS VARCHAR) || '|7'), 1, 16) AS sample_id FROM documents""")
def content_md5(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("content_md5"),
                                                 tx.sample_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string"), F.lit("7")).alias("sample_id"))
    return d.join(d.groupBy("content_md5").agg(F.count(F.lit(1)).alias("copies")), "content_md5")


@query("first_wins", "W1", "SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_key, doc_id FROM documents) GROUP BY text_key")
def first_wins_query(spark, folder):
    d = table(spark, folder, "documents").select(F.md5(F.encode("text", "utf-8")).alias("text_key"), "doc_id")
    return first_wins(d, ["text_key"], "doc_id")


# all that the user says against all that the assistant says, whole texts in turn order
_PIECES = """WITH p AS (SELECT conv_id, trim(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '')) AS a, trim(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS b
   FROM conversations GROUP BY conv_id),
 g AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(a), 1)), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i, 2))) AS gb FROM p) """


@query("ngram_jaccard", "X1 X2", _PIECES + """SELECT conv_id, len(ga)::INTEGER AS n_grams, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0
  WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) END, 6) AS sim FROM g""")
def ngram_jaccard(spark, folder):
    said = lambda role: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"]), " ")).alias(role)
    d = table(spark, folder, "conversations").groupBy("conv_id").agg(said("user"), said("assistant"))
    a, b = F.col("user"), F.col("assistant")
    return d.select("conv_id", F.size(tx.char_ngrams(a)).alias("n_grams"), F.round(tx.ngram_jaccard(a, b), 6).alias("sim"))


@query("text_fingerprints", "X20", f"WITH {si.FINGERPRINTS} SELECT doc_id, phash FROM documents LEFT JOIN prints USING (doc_id)")
def text_fingerprints(spark, folder):
    return si.fingerprints(spark, folder)


@query("vector_fingerprints", "X20", "SELECT vec_id, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS fingerprint FROM (SELECT vec_id, "
       + " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::HUGEINT ELSE 0::HUGEINT END)" for i in range(64)) + " AS v FROM embeddings)")
def vector_fingerprints(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", vi.sign_fingerprint(F.col("embedding")).alias("fingerprint"))


@query("nearest_label_distance", "X3", "WITH f AS (SELECT vec_id, label, fp, first_value(fp) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM (SELECT vec_id, label, CAST(CASE WHEN v >= 9223372036854775808 "
       "THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS fp FROM (SELECT vec_id, label, "
       + " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::HUGEINT ELSE 0::HUGEINT END)" for i in range(64))
       + " AS v FROM embeddings))) SELECT vec_id, bit_count(xor(fp, a))::INTEGER AS distance FROM f")
def nearest_label_distance(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label", vi.sign_fingerprint(F.col("embedding")).alias("fp"))
    anchor = e.groupBy("label").agg(F.min_by("fp", "vec_id").alias("a"))
    return e.join(anchor, "label").select("vec_id", vi.hamming(F.col("fp"), F.col("a")).cast("int").alias("distance"))


# stand-in metadata of a page's image: size, orientation and pixel mode from lengths of its html and url
_SIZE = """(SELECT page_id, length(html) % 3000 + 20 AS w, length(url) * 37 % 2000 + 20 AS h, CASE WHEN length(html) % 4 = 0 THEN length(url) % 10 END AS orientation,
   ['RGB', 'RGBA', 'CMYK', 'LA', 'L', 'P', 'pa'][length(html) % 9 + 1] AS mode FROM pages)"""
_IMAGE_FLAGS = """greatest(w, h) / greatest(least(w, h), 1) AS aspect, greatest(w, h) / greatest(least(w, h), 1) > 5 AS extreme_aspect, least(w, h) < 56 AS too_small,
   coalesce(orientation BETWEEN 2 AND 8, false) AS needs_rotation, coalesce(upper(mode) IN ('RGBA', 'LA', 'PA'), false) AS has_alpha, coalesce(mode = 'CMYK', false) AS is_cmyk"""


@query("image_issue_flags", "F22 A37", f"SELECT page_id, round(aspect, 6) AS aspect, * EXCLUDE (page_id, aspect) FROM (SELECT page_id, {_IMAGE_FLAGS} FROM {_SIZE})")
def image_issue_flags(spark, folder):
    return _page_flags(spark, folder).select("page_id", F.round("f.aspect", 6).alias("aspect"), "f.extreme_aspect", "f.too_small", "f.needs_rotation", "f.has_alpha", "f.is_cmyk")


def _page_flags(spark, folder):
    html, url = F.length("html"), F.length("url")
    modes = F.array(*map(F.lit, ("RGB", "RGBA", "CMYK", "LA", "L", "P", "pa")))
    return table(spark, folder, "pages").select("page_id", ru.image_issue_flags(html % 3000 + 20, url * 37 % 2000 + 20, F.when(html % 4 == 0, url % 10), F.get(modes, html % 9)).alias("f"))


@query("image_audit", "A37 F22", f"""SELECT count(*) AS n, count(*) FILTER (WHERE extreme_aspect) AS n_extreme, count(*) FILTER (WHERE too_small) AS n_small,
  count(*) FILTER (WHERE needs_rotation) AS n_rotated, count(*) FILTER (WHERE has_alpha) AS n_alpha, count(*) FILTER (WHERE is_cmyk) AS n_cmyk FROM (SELECT {_IMAGE_FLAGS} FROM {_SIZE})""")
def image_audit(spark, folder):
    flags = {"n_extreme": "extreme_aspect", "n_small": "too_small", "n_rotated": "needs_rotation", "n_alpha": "has_alpha", "n_cmyk": "is_cmyk"}
    return _page_flags(spark, folder).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(f"f.{c}"), 1)).alias(n) for n, c in flags.items()])


@query("reconcile", "J21 S14", f"""WITH {si.STAGED}, lab AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS kind,
   CASE WHEN quality = 1 THEN 'keep' ELSE 'rules' END AS expect, CASE WHEN doc_id % 6 = 0 THEN 'g' || CAST(doc_id // 24 AS VARCHAR) END AS grp FROM labels),
 j AS (SELECT lab.*, coalesce(dropped_at, 'keep') AS actual FROM lab JOIN stages USING (id)),
 gr AS (SELECT grp, count(*) FILTER (WHERE actual = 'keep') AS kept FROM j WHERE grp IS NOT NULL GROUP BY grp)
SELECT 'rows' AS "check", count(*) FILTER (WHERE expect = actual) AS ok, count(*) FILTER (WHERE expect <> actual) AS bad FROM j
UNION ALL SELECT 'groups', count(*) FILTER (WHERE kept = 1), count(*) FILTER (WHERE kept <> 1) FROM gr
UNION ALL SELECT 'must_keep', count(*) FILTER (WHERE actual = 'keep'), count(*) FILTER (WHERE actual <> 'keep') FROM j WHERE kind = 'plain'""")
def reconcile(spark, folder):
    done = st.run_stages(si.samples(spark, folder), cfg=si.CONFIG)
    i = F.col("doc_id")
    lab = table(spark, folder, "labels").select(
        i.cast("string").alias("id"), F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("plain")).alias("kind"),
        F.when(F.col("quality") == 1, F.lit("keep")).otherwise(F.lit("rules")).alias("expect"),
        F.when(i % 6 == 0, F.concat(F.lit("g"), F.floor(i / 24).cast("string"))).alias("group"))
    return st.reconcile(done, lab, ("plain",))


# ---- similarity ----

_TEXTS = "texts AS (SELECT min(doc_id) AS tid, trim(text) AS text FROM documents GROUP BY trim(text))"


@query("dedup_exact", "J1 R1", """SELECT doc_id AS seq, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) = 1 AS kept,
  CASE WHEN row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) > 1 THEN 'text' END AS kind FROM documents""")
def dedup_exact(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), "text")
    return dedup.dedup_exact(d).select("seq", "kept", "kind")


@query("dedup_exact_images", "J1 R1", """WITH s AS (SELECT doc_id AS seq, md5(text) AS text, CASE WHEN doc_id % 4 <> 0 THEN lang END AS img FROM documents),
 f AS (SELECT text, min(seq) AS first_any, arg_min(img IS NULL, seq) AS first_null FROM s GROUP BY text),
 r AS (SELECT s.seq, s.text, img, first_null, seq = first_any AS is_first, row_number() OVER (PARTITION BY s.text, img ORDER BY seq) AS rn FROM s JOIN f USING (text))
SELECT seq, is_first OR (NOT first_null AND img IS NOT NULL AND rn = 1) AS kept FROM r""")
def dedup_exact_images(spark, folder):
    """Every language is one image with a hash far from the others; every fourth sample has none."""
    d = table(spark, folder, "documents")
    s = d.select(F.col("doc_id").alias("seq"), "text", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).otherwise(F.lit("__none__")).alias("image_path"))
    codes = {"en": 0x0F0F0F0F0F0F0F0F, "fr": 0x00FF00FF00FF00FF, "de": 0x3333333333333333, "es": 0x5555555555555555}
    hashes = d.select(F.col("lang").alias("image_path")).distinct().withColumn(
        "phash", F.coalesce(*[F.when(F.col("image_path") == k, F.lit(v)) for k, v in codes.items()]))
    return dedup.dedup_exact(s, hashes).select("seq", "kept")


# The twin blocks by rare n-grams (a pair at 0.85 shares one of each side's rarest 15 %), then intersects the whole sets.
_GRAM_SETS = """g AS (SELECT DISTINCT {id} AS tid, hash(c || c1 || c2 || c3 || c4) AS gram FROM (SELECT {id}, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4
   FROM {chars} WINDOW w AS (PARTITION BY {id} ORDER BY i)) WHERE c4 IS NOT NULL),
 f AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
 r AS (SELECT g.tid, g.gram, row_number() OVER (PARTITION BY g.tid ORDER BY df, g.gram) AS pos, count(*) OVER (PARTITION BY g.tid) AS n FROM g JOIN f USING (gram)),
 x AS (SELECT tid, gram, n FROM r WHERE pos <= n - ceil(0.85 * n - 1e-9) + 1),
 s AS (SELECT tid, list(gram) AS gs, count(*) AS n FROM g GROUP BY tid)"""
_CHARS = "chars AS (SELECT tid, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM texts)"


@query("near_pairs", "J2 X1 X2 U6", f"""WITH {_TEXTS}, {_CHARS}, {_GRAM_SETS.format(id='tid', chars='chars')},
 k AS (SELECT DISTINCT u.tid AS a, v.tid AS b FROM x u JOIN x v ON u.gram = v.gram AND u.tid < v.tid AND least(u.n, v.n) >= greatest(u.n, v.n) * 0.85),
 p AS (SELECT k.a, k.b, len(list_intersect(u.gs, v.gs)) AS common, u.n AS na, v.n AS nb FROM k JOIN s u ON k.a = u.tid JOIN s v ON k.b = v.tid)
SELECT a, b, round(common / (na + nb - common), 6) AS sim FROM p WHERE common / (na + nb - common) >= 0.85""")
def near_pairs(spark, folder):
    return simjoin.near_pairs(_distinct_texts(spark, folder), 5, 0.85).select("a", "b", F.round("sim", 6).alias("sim"))


def _distinct_texts(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("tid"), tx.strip(F.col("text")).alias("text"))
    return first_wins(d.withColumn("_k", F.sha2(F.encode("text", "utf-8"), 256)), ["_k"], "tid").drop("_k")


# The sequential rule itself: one step per row that has an earlier neighbour, carrying the rows dropped so far.
_SIMILAR = f"""{_TEXTS}, {_CHARS}, {_GRAM_SETS.format(id='tid', chars='chars')},
 k AS (SELECT DISTINCT u.tid AS a, v.tid AS b FROM x u JOIN x v ON u.gram = v.gram AND u.tid < v.tid AND least(u.n, v.n) >= greatest(u.n, v.n) * 0.85),
 pr AS (SELECT k.a, k.b, len(list_intersect(u.gs, v.gs)) AS common, u.n AS na, v.n AS nb FROM k JOIN s u ON k.a = u.tid JOIN s v ON k.b = v.tid),
 near AS MATERIALIZED (SELECT a, b FROM pr WHERE common / (na + nb - common) >= 0.85),
 docs AS (SELECT doc_id, tid, texts.text FROM documents JOIN texts ON trim(documents.text) = texts.text),
 alike AS MATERIALIZED (SELECT u.doc_id AS a, v.doc_id AS b FROM docs u JOIN docs v ON u.tid = v.tid AND u.doc_id < v.doc_id AND u.text <> ''
           UNION SELECT least(u.doc_id, v.doc_id), greatest(u.doc_id, v.doc_id) FROM near JOIN docs u ON u.tid = a JOIN docs v ON v.tid = b)"""
_SCAN = """adj AS MATERIALIZED (SELECT b, list(a) AS prev, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY b),
 scan(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
   SELECT adj.i, CASE WHEN len(list_filter(prev, lambda q: NOT list_contains(gone, q))) > 0 THEN list_append(gone, b) ELSE gone END FROM scan JOIN adj ON adj.i = scan.i + 1),
 dropped AS (SELECT unnest(arg_max(gone, i)) AS seq FROM scan)"""


@query("dedup_near", "J2 R1 U6", f"""WITH RECURSIVE {_SIMILAR}, e AS (SELECT * FROM alike), {_SCAN}
SELECT doc_id AS seq, doc_id NOT IN (SELECT seq FROM dropped) AS kept, CASE WHEN doc_id IN (SELECT seq FROM dropped) THEN 'dup_pair' END AS note FROM docs""")
def dedup_near(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), "text")
    return dedup.dedup_near(d, n=5)


@query("dedup_near_images", "J2 R1", f"""WITH RECURSIVE {si.FINGERPRINTS.replace('chars', 'pchars')}, {_SIMILAR},
 h AS MATERIALIZED (SELECT docs.*, CASE WHEN docs.doc_id % 6 <> 0 THEN phash END AS h FROM docs LEFT JOIN prints ON prints.doc_id = docs.doc_id),
 e AS (SELECT alike.a, alike.b FROM alike JOIN h u ON u.doc_id = alike.a JOIN h v ON v.doc_id = alike.b WHERE u.h IS NULL OR v.h IS NULL OR bit_count(xor(u.h, v.h)) < 5), {_SCAN},
 kept AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT seq FROM dropped)),
 img AS (SELECT DISTINCT v.doc_id FROM kept u JOIN kept v ON u.doc_id < v.doc_id AND bit_count(xor(u.h, v.h)) < 5),
 txt AS (SELECT DISTINCT b AS doc_id FROM alike JOIN kept ON kept.doc_id = alike.a)
SELECT doc_id AS seq, doc_id IN (SELECT doc_id FROM kept) AS kept, CASE WHEN doc_id NOT IN (SELECT doc_id FROM kept) THEN 'dup_pair' WHEN doc_id IN (SELECT doc_id FROM img) THEN 'same_image_diff_text'
  WHEN doc_id IN (SELECT doc_id FROM txt) THEN 'dup_text' END AS note FROM h""")
def dedup_near_images(spark, folder):
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image_path"))
    prints = si.fingerprints(spark, folder).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image_path"), F.when(F.col("doc_id") % 6 != 0, F.col("phash")).alias("phash"))
    return dedup.dedup_near(d, prints, n=5)


@query("dedup_folded", "J2 R1 U6", """WITH f AS (SELECT doc_id, trim(text) AS text, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '', 'g') AS fold FROM documents),
 r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY CASE WHEN fold = '' THEN text ELSE fold END ORDER BY doc_id) AS rn FROM f)
SELECT doc_id AS seq, rn = 1 OR text = '' AS kept, CASE WHEN rn > 1 AND text <> '' THEN 'dup_pair' END AS note FROM r""")
def dedup_folded(spark, folder):
    """The sequential rule with another similarity: texts with the same letters and digits, whatever their case and marks."""
    def same_letters(texts):
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        t = texts.select("tid", F.regexp_replace(F.translate("text", upper, lower), "[^a-z0-9]", "").alias("fold")).filter("fold <> ''")
        first = t.groupBy("fold").agg(F.min("tid").alias("a"))  # the first one stands for its group
        return t.join(first, "fold").select("a", F.col("tid").alias("b")).filter("a <> b")

    return dedup.dedup_near(table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), "text"), similar=same_letters)


@query("near_pairs_lsh", "J3")
def near_pairs_lsh(spark, folder):
    return simjoin.near_pairs_lsh(_distinct_texts(spark, folder), 5, 0.85)


_SIDES = """pairs AS (SELECT e.doc_id AS ev, t.doc_id AS tr, bit_count(xor(e.phash, t.phash))::INTEGER AS d FROM prints e JOIN prints t ON e.doc_id % 5 = 0 AND t.doc_id % 5 <> 0
  WHERE bit_count(xor(e.phash, t.phash)) < 8)"""


def _leak_sides(spark, folder):
    p = si.fingerprints(spark, folder).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image_path"), "phash")
    from ..session import cut_lineage
    p = cut_lineage(p)
    return p.filter("doc_id % 5 <> 0"), p.filter("doc_id % 5 = 0")


@query("leakage_pairs", "J4 X3", f"WITH {si.FINGERPRINTS}, {_SIDES} SELECT 'd' || CAST(ev AS VARCHAR) AS eval_image, 'd' || CAST(tr AS VARCHAR) AS train_image, d AS distance FROM pairs")
def leakage_pairs(spark, folder):
    return dedup.leakage_pairs(*_leak_sides(spark, folder))


@query("leakage_report", "J4", f"""WITH {si.FINGERPRINTS}, {_SIDES}, n AS (SELECT count(*) FILTER (WHERE d.doc_id % 5 = 0 AND phash IS NOT NULL) AS ec, count(*) FILTER (WHERE d.doc_id % 5 <> 0 AND phash IS NOT NULL) AS tc,
  count(*) FILTER (WHERE d.doc_id % 5 = 0 AND phash IS NULL) AS es, count(*) FILTER (WHERE d.doc_id % 5 <> 0 AND phash IS NULL) AS ts FROM documents d LEFT JOIN prints p ON d.doc_id = p.doc_id),
 l AS (SELECT count(*) AS np, count(DISTINCT ev) AS ni FROM pairs)
SELECT ec AS n_eval_checked, tc AS n_train_checked, es AS n_eval_skipped, ts AS n_train_skipped, np AS n_leak_pairs, ni AS n_leak_eval_images,
  round(ec / (ec + es), 6) AS coverage, round(ni / ec, 6) AS leak_rate FROM n, l""")
def leakage_report(spark, folder):
    r = dedup.leakage_report(*_leak_sides(spark, folder))
    return r.withColumn("coverage", F.round("coverage", 6)).withColumn("leak_rate", F.round("leak_rate", 6))


@query("leakage_of_samples", "J4", f"""WITH {si.FINGERPRINTS}, {_SIDES}, n AS (SELECT count(*) FILTER (WHERE d.doc_id % 5 = 0 AND phash IS NOT NULL) AS ec, count(*) FILTER (WHERE d.doc_id % 5 <> 0 AND phash IS NOT NULL) AS tc,
  count(*) FILTER (WHERE d.doc_id % 5 = 0 AND phash IS NULL) AS es, count(*) FILTER (WHERE d.doc_id % 5 <> 0 AND phash IS NULL) AS ts FROM documents d LEFT JOIN prints p ON d.doc_id = p.doc_id),
 l AS (SELECT count(*) AS np, count(DISTINCT ev) AS ni FROM pairs)
SELECT ec AS n_eval_checked, tc AS n_train_checked, es AS n_eval_skipped, ts AS n_train_skipped, np AS n_leak_pairs, ni AS n_leak_eval_images,
  round(ec / (ec + es), 6) AS coverage, round(ni / ec, 6) AS leak_rate FROM n, l""")
def leakage_of_samples(spark, folder):
    """Held-out rows that name their images in a list only, next to placeholders."""
    t, e = _leak_sides(spark, folder)
    held = e.select(F.array("image_path", F.lit("__text_only__"), F.lit("")).alias("images"))
    r = dedup.leakage_of_samples(t.select("image_path"), held, t.select("image_path", "phash").unionByName(e.select("image_path", "phash")).distinct())
    return r.withColumn("coverage", F.round("coverage", 6)).withColumn("leak_rate", F.round("leak_rate", 6))


@query("duplicate_groups", "J5 R2", f"""WITH RECURSIVE {si.FINGERPRINTS}, e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM prints a JOIN prints b ON a.doc_id <> b.doc_id AND bit_count(xor(a.phash, b.phash)) < 5),
 c(node, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, c.root FROM c JOIN e ON c.node = e.x)
SELECT node AS id, min(root) AS component FROM c GROUP BY node""")
def duplicate_groups(spark, folder):
    p = si.fingerprints(spark, folder).select(F.col("doc_id").alias("id"), F.col("phash").alias("h"))
    return dedup.image_groups(p)


_SENTENCES = """parts AS (SELECT {id} * 1000000 + generate_subscripts(regexp_split_to_array(text, '\\.\\s+'), 1) - 1 AS k, trim(unnest(regexp_split_to_array(text, '\\.\\s+'))) AS text FROM {t})"""


@query("benchmark_overlap", "J2 J4", f"""WITH d AS (WITH {_SENTENCES.format(id='doc_id', t='documents')} SELECT min(k) AS tid, text FROM parts GROUP BY text), b AS (WITH {_SENTENCES.format(id='item_id', t='benchmark')} SELECT -1 - min(k) AS tid, text FROM parts GROUP BY text),
 texts AS (SELECT * FROM d UNION ALL SELECT * FROM b), {_CHARS}, {_GRAM_SETS.format(id='tid', chars='chars')},
 k AS (SELECT DISTINCT u.tid AS a, v.tid AS b FROM x u JOIN x v ON u.gram = v.gram AND u.tid < 0 AND v.tid >= 0 AND least(u.n, v.n) >= greatest(u.n, v.n) * 0.85),
 p AS (SELECT k.a, k.b, len(list_intersect(u.gs, v.gs)) AS common, u.n AS na, v.n AS nb FROM k JOIN s u ON k.a = u.tid JOIN s v ON k.b = v.tid)
SELECT -1 - a AS item_sentence, b AS doc_sentence, round(common / (na + nb - common), 6) AS sim FROM p WHERE common / (na + nb - common) >= 0.85
UNION ALL SELECT -1 - b.tid, d.tid, 1.0 FROM b JOIN d USING (text) WHERE length(text) BETWEEN 1 AND 4""")
def benchmark_overlap(spark, folder):
    """Held-out sentences that occur, nearly, in the documents."""
    def sentences(name: str, key: str, passes=None):
        d = table(spark, folder, name).select(key, F.posexplode(F.split("text", r"\.\s+")).alias("pos", "text"))
        d = d.select((F.col(key) * 1000000 + F.col("pos")).alias("tid"), tx.strip(F.col("text")).alias("text"))
        return first_wins(d.filter(passes("text")) if passes else d, ["text"], "tid")

    items = cut_lineage(sentences("benchmark", "item_id"))
    p = simjoin.cross_near_pairs(items, sentences("documents", "doc_id", simjoin.may_reach(items, 5, 0.85)), 5, 0.85)
    return p.select(F.col("a").alias("item_sentence"), F.col("b").alias("doc_sentence"), F.round("sim", 6).alias("sim"))


@query("image_dedup_stages", "J1 F9 U7")
def image_dedup_stages(spark, folder):
    """All stages with image hashes and the consistency check, counted by stage and intent."""
    s = si.samples(spark, folder)
    hashes = si.fingerprints(spark, folder).join(s.select(F.col("seq").alias("doc_id"), "image_path"), "doc_id").filter("not startswith(image_path, '__')")
    hashes = hashes.groupBy("image_path").agg(F.min_by("phash", "doc_id").alias("phash"))
    e = table(spark, folder, "embeddings")
    anchor = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("text_vec"))
    vec = e.join(anchor, "label").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("image_vec"), "text_vec")
    done = st.run_stages(s, hashes, si.CONFIG, vec)
    return done.groupBy(F.coalesce("dropped_at", F.lit("keep")).alias("stage"), "intent").agg(F.count(F.lit(1)).alias("n"))
