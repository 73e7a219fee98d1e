"""Rules, stages, splits, rewards and sources on the published small cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from gleanworks import lexicons as lx, schemas as sc
from gleanworks.functions import jsonx, rewards as rw, rules as ru, shop as sh, text as tx
from gleanworks.operators import evaluation as ev, packing as pk, preferences as pr, stages as st
from gleanworks.ordering import exact_quantiles, rank_in_groups, running_sums
from gleanworks.sources import io

REPLY = "这款毛衣的面料是棉混纺，从图片看版型宽松，日常穿着会比较舒服，您可以放心选择。"


def _msgs(user, reply):
    m = [{"role": "user", "content": [{"type": "image", "text": None, "path": "p"}, {"type": "text", "text": user, "path": None}]}]
    return m + ([{"role": "assistant", "content": [{"type": "text", "text": reply, "path": None}]}] if reply is not None else [])


def _demo():
    """120 clean rows and the injected kinds of the published demo set, with a group for copies."""
    rows, hashes = [], {}

    def add(kind, expect, user, reply=REPLY, image=None, group=None, h=None):
        i = len(rows)
        path = f"img{i}" if image is None else image
        rows.append((i, str(i), path or None, "t", "x", 1, _msgs(user, reply), kind, expect, group))
        if path and path not in hashes:
            hashes[path] = h if h is not None else (i * 0x9E3779B97F4A7C15) % 2**63
        return i

    for k in range(112):
        add("clean", "keep", f"第{k}件衣服的面料摸起来手感怎么样呢")
    for k in range(8):
        add("clean", "dedup_group", f"第{k}款外套会不会起球", image=f"dup{k}", group=f"g{k}")
    for k in range(3):
        add("short", "rules", "好吗")
    for k in range(2):
        add("contact", "rules", f"第{k}个问题请打这个电话一三八", reply=REPLY + "13812345678")
    for k in range(2):
        add("self", "rules", f"第{k}个问题你是谁呀", reply="作为AI" + REPLY)
    for k in range(2):
        add("one", "format", f"第{k}个问题没有回复", reply=None)
    add("noimg", "format", "这个问题没有图片路径", image="")
    for k in range(8):
        add("dup", "dedup_group", f"第{k}款外套会不会起球", image=f"dup{k}", group=f"g{k}")
    for k in range(6):
        add("valid_same_img_diff_text", "keep", f"换一个问法来问第{k}件", image=f"img{k}")
    for k in range(4):
        add("valid_same_text_diff_img", "keep", f"第{k}件衣服的面料摸起来手感怎么样呢")
    for k in range(5):
        add("near", "keep", f"第{k + 20}件衣服的面料摸起来手感怎么样呢啊", image=f"img{k + 20}")
    add("real_black_image", "keep", "这张图是全黑的可以看吗", h=0)
    return rows, hashes


def test_demo_waterfall_and_reconciliation(spark):
    rows, hashes = _demo()
    df = spark.createDataFrame([r[:7] for r in rows], f"seq long, id string, image_path string, image_type string, intent string, difficulty int, messages {sc.CONTENT}")
    done = st.run_stages(df, spark.createDataFrame(list(hashes.items()), "image_path string, phash long"))
    assert [r.alive for r in st.waterfall(done).orderBy("step").collect()] == [154, 151, 144, 144, 136]
    labels = spark.createDataFrame([(r[1], r[7], r[8], r[9]) for r in rows], "id string, kind string, expect string, `group` string")
    got = {r.check: (r.ok, r.bad) for r in st.reconcile(done, labels, ("valid_same_img_diff_text", "valid_same_text_diff_img", "near", "real_black_image")).collect()}
    assert got == {"rows": (138, 0), "groups": (8, 0), "must_keep": (16, 0)}


def test_published_rule_cases(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("r")).first().r
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    assert pick(ru.check_must_contain(F.lit("一处轻微的线头，属于正常工艺范围"), arr("正常", "工艺"))).passed
    assert not pick(ru.check_must_not_contain(F.lit("这是严重质量问题，必须退货"), arr("必须退货"))).passed
    assert pick(ru.check_refusal(F.lit("方便告诉我您的身高体重吗？"), F.lit(True))).passed
    assert not pick(ru.check_refusal(F.lit("我穿 M 应该可以的"), F.lit(True))).passed
    assert not pick(ru.check_over_promise(F.lit("这个绝对不会起球，我保证不会"))).passed
    assert not pick(ru.check_pii_leak(F.lit("您的订单电话 13812345678 已更新"))).passed
    assert pick(ru.check_pii_leak(F.lit("您的订单电话 138****5678 已更新"))).passed
    assert pick(tx.mask_pii(F.lit(" 电话13812345678<|im_end|> "))) == "电话138****5678"
    v = pick(ru.evaluate_rules(F.lit("领口有一处线头，属于正常工艺范围"), arr("线头", "工艺"), arr("必须退货"), F.lit(False), F.lit(None).cast("string")))
    assert v.passed and v.score == 1.0 and set(v.checks) == {"must_contain", "must_not_contain", "refusal", "over_promise", "pii"}


def test_answer_probes_order_as_published(spark):
    """Constructed answers pass everything; an answer that only refuses does worst."""
    t = ev.eval_templates(spark).withColumn("id", F.col("template")).withColumn("expected_intent", F.lit(None).cast("string"))
    refusal = "这个问题我还需要更多信息才能判断，方便告诉我您的身高体重吗？也可以帮您转接人工客服"
    assert ev.oracle_failures(t, refusal).count() == 0
    silent = ev.judge_answers(t.withColumn("model_answer", F.lit("我无法确定，建议您咨询人工客服。")))
    assert silent.filter("rule.passed").count() < t.count() / 3
    assert ev.lint_templates(t).count() == 0


def test_oracle_failures_look_for_one_word_first(spark):
    """A passing row with thousands of words to look for costs no more than its length; failing rows are still judged in full."""
    rows = [(1, 20_000, None), (2, 20_000, None), (3, 4, "w100002")]
    t = spark.createDataFrame(rows, "id long, n int, bad string").select(
        "id", F.transform(F.sequence(F.lit(100_000), F.lit(99_999) + F.col("n")), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("must_contain"),
        F.array(F.coalesce(F.substring("bad", 1, 6), F.lit("zzz"))).alias("must_not_contain"), F.lit(False).alias("should_refuse"), F.lit(None).cast("string").alias("expected_intent")).cache()
    t.count()

    def timed(df):
        start = time.perf_counter()
        return df.collect(), time.perf_counter() - start

    full = ev.judge_answers(t.withColumn("model_answer", F.array_join("must_contain", "、"))).select("rule.passed")
    timed(full), timed(ev.oracle_failures(t, "no").select("id"))
    assert timed(ev.oracle_failures(t, "no").select("id"))[1] < timed(full)[1] / 2
    bad = ev.oracle_failures(t, "no").collect()
    assert [r.id for r in bad] == [3] and len(bad[0].must_contain) == 4
    assert bad[0].rule.checks["must_contain"].passed and not bad[0].rule.checks["must_not_contain"].passed


def test_json_extraction_and_rewards(spark):
    cases = ['{"action": "a"}', 'x ```json\n{"action": "b", "k": 1}\n``` y', 'so {bad {"action": "c"} end', "no json", "{unclosed"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [json.loads(r.j)["action"] if r.j else None for r in df.select("i", jsonx.extract_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got == ["a", "b", "c", None, None]
    claims = spark.createDataFrame([("这件浅蓝色圆领有线头", ["深蓝色裤", "线头"])], "t string, v array<string>").select(rw.visual_claims(F.col("t"), F.col("v")).alias("c")).first().c
    assert set(claims.grounded) == {"线头"} and set(claims.phantom) == {"浅蓝色", "圆领"}
    lp = spark.createDataFrame([(-1.0, -2.0, -1.0, -2.0)], "pc double, pr double, rc double, rr double")
    assert pr.dpo_metrics(lp).first().loss == pytest.approx(0.6931471805599453)


def test_split_keeps_groups_whole_and_placeholders_single(spark):
    rows = [(i, f"img{i // 3}", "a", "b") for i in range(36)] + [(100 + i, "__no_image__", "c", "d") for i in range(20)]
    s = pk.split_by_group(spark.createDataFrame(rows, "seq long, image_path string, intent string, image_type string"))
    assert pk.split_overlap(s).count() == 0
    by = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert set(by) == {"train", "val", "test"} and by["train"] > 30
    again = pk.split_by_group(spark.createDataFrame(rows, "seq long, image_path string, intent string, image_type string").repartition(7))
    assert {(r.seq, r.split) for r in s.collect()} == {(r.seq, r.split) for r in again.collect()}
    few = pk.split_by_group(spark.createDataFrame(rows[:6], "seq long, image_path string, intent string, image_type string"))
    assert {r.split for r in few.collect()} == {"train"}


def test_ranks_sums_and_quantiles_under_one_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id", (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    r = running_sums(rank_in_groups(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100), "rn"), ["k"], [F.col("id")], F.floor(F.col("id") / 100), {"s": F.lit(1)})
    assert r.filter("rn <> s").count() == 0 and r.filter("k = 'hot'").agg(F.max("rn")).first()[0] == 2000
    vals = sorted(x.v for x in df.collect())
    for small in (10, 10**6):
        q = exact_quantiles(df, [], "v", {"a": (0.5, "linear"), "b": (0.95, "index"), "c": (0.5, "lower")}, small=small, slack=0.01).first()
        assert (q.a, q.b, q.c) == ((vals[1499] + vals[1500]) / 2, vals[int(3000 * 0.95)], vals[1499])


def test_sources_guards_and_signatures(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"id": "a", "intent": "x"}\n\nnot json\n{"id": "b"}\n', encoding="utf-8")
    got = io.read_samples(spark, str(f))
    c = io.count_malformed(got).first()
    assert (c.n_ok, c.n_malformed) == (2, 1)
    assert [r.id for r in got.filter("id is not null").orderBy("seq").collect()] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        io.read_samples(spark, str(tmp_path / "none"))
    out = str(tmp_path / "out")
    io.write_guarded(spark.range(3), out)
    with pytest.raises(ValueError):
        io.write_guarded(spark.range(0), out)
    assert spark.read.parquet(out).count() == 3
    img = tmp_path / "img" / "sub"
    img.mkdir(parents=True)
    for n in ("a.jpg", ".b.png", "c.txt", "d.webp"):
        (img / n).write_bytes(b"x")
    assert io.scan_images(spark, str(tmp_path / "img")).count() == 2
    assert set(sc.warehouse_schemas()) >= {"shops", "sessions", "messages", "usage_records"}
    import base64
    import hashlib
    import hmac
    sig = base64.b64encode(hmac.new(b"k", b"body", hashlib.sha256).digest()).decode()
    q = "code=1&shop=a.myshopify.com&state=z"
    h = hmac.new(b"k", q.encode(), hashlib.sha256).hexdigest()
    r = spark.range(1).select(sh.valid_body(F.encode(F.lit("body"), "utf-8"), F.lit(sig), "k").alias("a"), sh.valid_body(F.encode(F.lit("body!"), "utf-8"), F.lit(sig), "k").alias("b"),
                              sh.valid_query(F.lit(f"state=z&hmac={h}&shop=a.myshopify.com&code=1"), "k").alias("c"), sh.valid_query(F.lit(f"hmac={h}&shop=b"), "k").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (True, False, True, False)
    assert lx.PLANS["free"][1] == 50


def test_reports_run_the_stages_once(spark):
    from gleanworks.operators import stages as st
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def reason(i):
        seen.add(1)
        return "too long(9)" if i % 2 else None

    df = spark.range(40).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), reason("id").alias("reason")).withColumn("dropped_at", F.when(F.col("reason").isNotNull(), "rules"))
    labels = spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit("plain").alias("kind"), F.lit("keep").alias("expect"), F.lit(None).cast("string").alias("group"))
    assert [r.n for r in st.rejection_report(df, F.col("id")).collect()] == [20]
    once = seen.value
    assert {(r.check, r.ok, r.bad) for r in st.reconcile(df, labels, ("plain",)).collect()} == {("rows", 20, 20), ("groups", 0, 0), ("must_keep", 20, 20)}
    assert once <= 80 and seen.value - once <= 80
