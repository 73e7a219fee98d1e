"""Queries that run as streams over the given tables, privacy requests, image frames, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import lexicons as lx, schemas as sc
from ..functions import shop as sh, vision as vi
from ..operators import agent as ag, evaluation as ev, preferences as pr
from ..session import checkpoint_dir, cut_lineage, one_row
from ..sources import io
from ..streaming import ingest as ing, stateful as stf
from . import standins as si
from .operations import LIMITS, _LEDGER
from .registry import query, table

_S = f"WITH {si.STEPS}"


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/gleanworks/{uuid.uuid4().hex}"


def _run(stream, complete: bool = False):
    """Drive a stream over everything there is and read its output table."""
    spark = stream.sparkSession
    base = _scratch(spark)
    w = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if complete:
        q = w.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        q = w.format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(folder)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _step_stream(spark, folder):
    e = _event_stream(spark, folder).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    kind = F.when(F.col("event_type") == "purchase", F.lit("tool")).when(F.col("event_type") == "signup", F.lit("guard")).otherwise(F.lit("model"))
    act = F.when(F.col("k") % 4 == 1, F.lit("abort")).when(F.col("k") % 4 == 2, F.lit("escalate")).otherwise(F.lit("continue"))
    return e.select(F.col("user_id").alias("session_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("turn"), "ts", F.col("event_id").alias("seq"),
                    (kind == "tool").alias("is_tool"), (F.col("value") / 10000).alias("cost"), (F.col("k") * 11).alias("tokens"), F.concat_ws("|", "event_type", (F.col("k") % 3).cast("string")).alias("action_key"),
                    kind.alias("kind"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"), (F.col("k") * 10).alias("in_tokens"), F.col("k").alias("out_tokens"),
                    F.when(kind == "guard", F.create_map(F.lit("action"), act)).otherwise(F.create_map().cast("map<string,string>")).alias("detail"))


@query("guardrail_monitor", "T6 W9", _S + """, a AS (SELECT *, row_number() OVER t AS n, sum((kind = 'tool')::INT) OVER t - (kind = 'tool')::INT AS tools, min(ts) OVER (PARTITION BY session_id, turn) AS t0, sum(cost) OVER s - cost AS c, sum(in_tokens + out_tokens) OVER s - in_tokens - out_tokens AS tk,
   dense_rank() OVER (PARTITION BY session_id ORDER BY turn) AS turns FROM steps WINDOW t AS (PARTITION BY session_id, turn ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT session_id, seq, list(action_key) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev FROM steps WHERE kind = 'tool'),
 g AS (SELECT a.session_id, a.turn, a.seq, a.ts, CASE WHEN n > 2 THEN 'steps' WHEN tools > 1 THEN 'tools' WHEN epoch(a.ts) - epoch(t0) > 20000 THEN 'wall_clock' WHEN c > 0.05 THEN 'cost' WHEN tk > 4000 THEN 'tokens' WHEN turns > 20 THEN 'turns'
   WHEN list_contains(p.prev, action_key) THEN 'repeat' END AS gate FROM a LEFT JOIN p ON a.session_id = p.session_id AND a.seq = p.seq)
SELECT session_id, arg_min(turn, (ts, seq)) AS turn, arg_min(seq, (ts, seq)) AS seq, arg_min(gate, (ts, seq)) AS gate FROM g WHERE gate IS NOT NULL GROUP BY session_id""")
def guardrail_monitor(spark, folder):
    spark.conf.set(*stf.ROCKSDB)
    return _run(stf.guardrail_monitor(_step_stream(spark, folder), LIMITS, late="0 seconds", idle_ms=90 * 86_400_000))


@query("usage_meter", "T7 W11", f"WITH RECURSIVE {_LEDGER} SELECT seq, shop, key, outcome, charged FROM ledger")
def usage_meter(spark, folder):
    spark.conf.set(*stf.ROCKSDB)
    e = _event_stream(spark, folder)
    e = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("shop"), F.date_format("ts", "yyyy-MM").alias("period"),
                 F.concat_ws("|", F.col("user_id").cast("string"), F.regexp_extract("props", "[0-9]+", 0)).alias("key"), si.amount_column().alias("amount"), "ts")
    plan = F.coalesce("plan", F.lit("free"))
    included = F.coalesce(*[F.when(plan == p, F.lit(v[1])) for p, v in si.PLANS.items()])
    j = e.join(si.subscriptions(spark, folder), "shop", "left").select("seq", "key", "shop", "period", "amount", "ts", included.alias("included"), F.coalesce("subscription_id", F.lit("")).alias("subscription_id"),
                                                                       F.coalesce("capped_amount", F.lit(0)).cast("decimal(10,4)").alias("cap"))
    return _run(stf.usage_meter(j, late="0 seconds", idle_ms=None)).withColumn("charged", F.col("charged").cast("double"))


_WEB = "SELECT CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(event_id // 3 AS VARCHAR) END AS webhook_id, event_id FROM events"


def _webhook_stream(spark, folder, forge: bool):
    body = F.when(F.col("event_id") % 13 == 0, F.lit("not json {")).otherwise(F.col("props"))
    sig = sh.body_signature(F.encode(body, "utf-8"), "secret")
    return _event_stream(spark, folder).select(
        F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.floor(F.col("event_id") / 3).cast("string")).alias("webhook_id"), F.lit("ORDERS_CREATE").alias("topic"), F.col("user_id").cast("string").alias("shop"),
        F.encode(body, "utf-8").alias("body"), F.when(F.lit(forge) & (F.col("event_id") % 19 == 0), F.lit("forged")).otherwise(sig).alias("signature"), "ts")


@query("ingest_events", "T1 T2 S15 F25", """WITH w AS (SELECT CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(event_id // 3 AS VARCHAR) END AS wid, event_id, event_id % 19 = 0 AS forged FROM events),
 g AS (SELECT wid, count(*) AS n FROM w WHERE NOT forged AND wid <> '' GROUP BY wid)
SELECT 'bad_signature' AS outcome, count(*) AS n FROM w WHERE forged UNION ALL SELECT 'passed', (SELECT count(*) FROM g) + (SELECT count(*) FROM w WHERE NOT forged AND wid = '')""")
def ingest_events(spark, folder):
    """Signature, then delivery id, then body. Which copy of a delivery survives is not fixed, so the counts join 200 and 400."""
    out = _run(ing.classify(_webhook_stream(spark, folder, True), "secret"))
    return out.groupBy(F.when(F.col("status") == 401, F.lit("bad_signature")).otherwise(F.lit("passed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_sinks", "T1 T2 S15", """WITH w AS (SELECT CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(event_id // 3 AS VARCHAR) END AS wid, (event_id // 3) % 13 = 0 AS broken, event_id % 19 = 0 AS forged FROM events),
 g AS (SELECT wid, bool_or(broken) AS broken FROM w WHERE NOT forged AND wid <> '' GROUP BY wid UNION ALL SELECT wid, broken FROM w WHERE NOT forged AND wid = '')
SELECT 200 AS status, count(*) FILTER (WHERE NOT broken) AS n FROM g UNION ALL SELECT 400, count(*) FILTER (WHERE broken) FROM g UNION ALL SELECT 401, count(*) FROM w WHERE forged""")
def ingest_sinks(spark, folder):
    """The two-sink job in several micro-batches: one fails between both sinks and is run again, and one is replayed after its commit. Readers see every batch once."""
    base = _scratch(spark)
    body = F.when(F.floor(F.col("event_id") / 3) % 13 == 0, F.lit("not json {")).otherwise(F.col("props"))
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.floor(F.col("event_id") / 3).cast("string")).alias("webhook_id"), F.lit("ORDERS_CREATE").alias("topic"),
        F.col("user_id").cast("string").alias("shop"), F.encode(body, "utf-8").alias("body"),
        F.when(F.col("event_id") % 19 == 0, F.lit("forged")).otherwise(sh.body_signature(F.encode(body, "utf-8"), "secret")).alias("signature"), "ts")
    events.repartition(3, "webhook_id").write.json(f"{base}/in")
    stream = lambda: ing.event_source(spark, f"{base}/in", per_trigger=1)
    failed = []

    def once(batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost between both sinks")

    try:
        ing.ingest_events(stream(), "secret", f"{base}/out", f"{base}/checkpoint", ttl="4000 days", between=once).awaitTermination()
    except StreamingQueryException:
        pass
    ing.ingest_events(stream(), "secret", f"{base}/out", f"{base}/checkpoint", ttl="4000 days", between=once).awaitTermination()
    # batch 0 once more, as after a crash before the stream's own checkpoint: its new attempt takes the place of the old one
    for sink in ing.SINKS:
        spark.read.parquet(f"{base}/out/{sink}/batch=0").drop("attempt").write.parquet(f"{base}/out/{sink}/batch=0/attempt=again")
    ing.commit_batch(spark, f"{base}/out", 0, "again")
    seen = ing.committed(spark, f"{base}/out", "accepted").select("status").unionByName(ing.committed(spark, f"{base}/out", "quarantine").select("status"))
    return seen.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("trace_rollup_stream", "T9", _S + """ SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_steps, round(sum(ms), 6) AS total_ms, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, count(*) FILTER (WHERE NOT ok) AS n_failures,
  coalesce(bool_or(action IN ('abort', 'escalate')), false) AS aborted FROM steps GROUP BY 1""")
def trace_rollup_stream(spark, folder):
    r = _run(ing.trace_rollup(_step_stream(spark, folder), "1 hour"), complete=True)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_steps", F.round("total_ms", 6).alias("total_ms"), "out_tokens", "n_failures", "aborted")


_CHG = """chg AS (SELECT 'u' || CAST(user_id % 9 AS VARCHAR) AS shop, regexp_extract(props, '[0-9]+') AS id, event_id AS seq, ts, event_type = 'error' AS deleted FROM events)"""


@query("product_index_sync", "T4 W16", f"WITH {_CHG}, r AS (SELECT *, row_number() OVER (PARTITION BY shop, id ORDER BY ts DESC, seq DESC) AS rn FROM chg) SELECT shop, id, seq FROM r WHERE rn = 1 AND NOT deleted")
def product_index_sync(spark, folder):
    c = _event_stream(spark, folder).select(F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("shop"), F.regexp_extract("props", "[0-9]+", 0).alias("id"), F.col("event_id").alias("seq"),
                                            F.col("ts").alias("updated_at"), (F.col("event_type") == "error").alias("deleted"))
    base = _scratch(spark)
    ing.product_index_sync(c, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    ing.compact_index(spark, f"{base}/index")
    return ing.current_index(spark, f"{base}/index").select("shop", "id", "seq")


@query("failed_events", "T8 T3", "SELECT CASE WHEN user_id % 5 = 3 THEN 'no handler' ELSE 'boom' END AS error, CASE WHEN user_id % 5 = 3 THEN 0 ELSE 3 END::INTEGER AS attempts, count(*) AS n FROM events WHERE user_id % 5 IN (1, 3) GROUP BY ALL")
def failed_events(spark, folder):
    """One route whose handler always fails and one without handler end in the dead-letter table."""
    topics = F.array(*[F.lit(t) for t in ("PRODUCTS_UPDATE", "orders/create", "shop_redact", "carts/update", "refunds/create")])
    e = _event_stream(spark, folder).select("event_id", F.get(topics, (F.col("user_id") % 5).cast("int")).alias("topic"))
    base = _scratch(spark)

    def boom(batch, batch_id):
        raise ValueError("boom")

    ok = lambda b, i: b.write.mode("overwrite").parquet(f"{base}/ok/{b.sparkSession.sparkContext.applicationId}/{i}")
    handlers = {"products/update": ok, "orders/create": boom, "shop/redact": ok, "refunds/create": ok}
    e.writeStream.foreachBatch(ing.handle_with_retry(handlers, base)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/dead").groupBy("error", "attempts").agg(F.count(F.lit(1)).alias("n"))


# ---- privacy requests over conversations ----

def _shop_tables(spark, folder):
    c = table(spark, folder, "conversations")
    k = F.col("conv_id")
    sessions = c.select(k.cast("string").alias("id"), (k % 4).cast("int").alias("shop_id"), (k % 10).cast("string").alias("customer_id")).distinct()
    return {"messages": c.select(k.cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content")), "sessions": sessions}


@query("redact_customers", "T5", "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn FROM conversations WHERE NOT (conv_id % 4 = 1 AND conv_id % 10 IN (1, 5))")
def redact_customers(spark, folder):
    t = _shop_tables(spark, folder)
    req = t["sessions"].filter("shop_id = 1 and customer_id in ('1', '5')").select("shop_id", "customer_id")
    return ing.redact_customers(t, req)[0]["messages"].select("session_id", "turn")


@query("redact_shops", "T5", "SELECT 'messages' AS name, count(*) AS n FROM conversations WHERE conv_id % 4 <> 2 UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 <> 2")
def redact_shops(spark, folder):
    t = _shop_tables(spark, folder)
    out, _ = ing.redact_shops(t, t["sessions"].filter("shop_id = 2").select("shop_id"))
    parts = [out[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("messages", "sessions")]
    return parts[0].unionByName(parts[1])


# ---- frames derived from the vectors ----

_D = vi._dct_matrix(32)[:8].tolist()
_P = ", ".join("(" + " + ".join(f"({_D[u][x]!r}) * e[{x + 1}]" for x in range(32)) + ")" for u in range(8))
_Q = ", ".join("(" + " + ".join(f"({_D[v][y]!r}) * e[{y + 33}]" for y in range(32)) + ")" for v in range(8))
_LOW = ", ".join(f"p[{i // 8 + 1}] * q[{i % 8 + 1}]" for i in range(64))
_HBITS = " + ".join(f"(CASE WHEN low[{i + 1}] > med THEN {1 << (63 - i)}::HUGEINT ELSE 0::HUGEINT END)" for i in range(64))


def _frames(spark, folder):
    """32 x 32 grey frames as outer products of the two halves of a vector."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    gray = F.flatten(F.transform(F.slice(e, 1, 32), lambda a: F.transform(F.slice(e, 33, 32), lambda b: a * b)))
    return ev.compute_once(table(spark, folder, "embeddings"), "gray", gray).select("vec_id", "gray")


@query("frame_hashes", "X19", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, [{_P}] AS p, [{_Q}] AS q FROM v), l AS (SELECT vec_id, [{_LOW}] AS low FROM s),
 m AS (SELECT vec_id, low, list_sort(low[2:])[32] AS med FROM l), b AS (SELECT vec_id, {_HBITS} AS h FROM m)
SELECT vec_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS phash FROM b""")
def frame_hashes(spark, folder):
    return _frames(spark, folder).select("vec_id", vi.phash64("gray").alias("phash"))


@query("collage_lines", "X21")
def collage_lines(spark, folder):
    return _frames(spark, folder).withColumn("lines", vi.collage_lines("gray")).select("vec_id", F.size("lines").alias("n_lines"), (F.size("lines") >= 2).alias("is_collage"))


# ---- sources and sinks: written from the given tables and read back ----

@query("samples_round_trip", "S1 S2 S3", "SELECT count(*) AS n_ok, 0::BIGINT AS n_malformed, sum(length(text))::BIGINT AS chars FROM documents")
def samples_round_trip(spark, folder):
    s = si.samples(spark, folder).select("id", "image_path", "image_type", "intent", "difficulty", "messages")
    base = _scratch(spark)
    report = s.agg(F.count(F.lit(1)).alias("n"))
    io.write_guarded(s.withColumn("messages", F.col("messages")), f"{base}/samples", report, f"{base}/report", fmt="json")
    back = io.require_nonempty(io.read_samples(spark, f"{base}/samples"))
    texts = F.coalesce(F.length(F.get(F.get("messages", F.lit(1))["content"], F.lit(0))["text"]), F.lit(0))
    kept = table(spark, folder, "documents").filter("doc_id % 37 = 0").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)))
    return back.agg(F.count(F.when(F.col("_corrupt_record").isNull(), 1)).alias("n_ok"), F.count("_corrupt_record").alias("n_malformed"), F.sum(texts).alias("chars")).withColumn("chars", F.col("chars") + kept.scalar())


@query("runs_from_files", "S6", "SELECT 'run_' || CAST(doc_id % 3 AS VARCHAR) AS tag, count(*) AS n, round(avg(n_chars * 0.125 + doc_id % 700), 6) AS latency FROM documents GROUP BY 1")
def runs_from_files(spark, folder):
    rec = table(spark, folder, "documents").select(F.concat(F.lit("run_"), (F.col("doc_id") % 3).cast("string")).alias("t"), F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") * 0.125 + F.col("doc_id") % 700).alias("latency_ms"))
    base = _scratch(spark)
    for t in ("run_0", "run_1", "run_2"):
        rec.filter(F.col("t") == t).drop("t").write.json(f"{base}/{t}")
    _rename_parts(spark, base, ("run_0", "run_1", "run_2"))
    r = io.read_runs(spark, f"{base}/*/*/eval_*.json")
    return r.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency"))


def _rename_parts(spark, base, tags):
    """Give part files the names an evaluation job uses."""
    for t in tags:
        fs, p = io._fs(spark, f"{base}/{t}")
        for i, st in enumerate(fs.listStatus(p)):
            name = st.getPath().getName()
            if name.startswith("part-"):
                _, to = io._fs(spark, f"{base}/{t}/{i}")
                fs.mkdirs(to)
                _, file = io._fs(spark, f"{base}/{t}/{i}/eval_{t}_raw.json")
                fs.rename(st.getPath(), file)


@query("traces_round_trip", "S9 A31", _S + " SELECT session_id::VARCHAR AS session_id, count(*) AS n_steps, round(sum(ms), 6) AS total_ms, CAST(sum(in_tokens) AS BIGINT) AS in_tokens FROM steps GROUP BY 1")
def traces_round_trip(spark, folder):
    s = si.steps(spark, folder).withColumn("session_id", F.col("session_id").cast("string")).withColumn("idx", F.col("idx").cast("int"))
    base = _scratch(spark)
    io.write_traces(s, f"{base}/traces")
    back = ag.trace_summary(io.read_traces(spark, f"{base}/traces"))
    return back.select("session_id", "n_steps", F.round("total_ms", 6).alias("total_ms"), "in_tokens")


@query("samples_malformed", "S1 S2", f"WITH {si.SAMPLES} SELECT count(*) FILTER (WHERE seq % 7 <> 0) AS n_ok, count(*) FILTER (WHERE seq % 7 = 0) AS n_malformed FROM samples")
def samples_malformed(spark, folder):
    """Lines of which every seventh is cut off, blank lines between them."""
    line = F.to_json(F.struct("id", "image_path", "image_type", "intent", "difficulty", "messages"))
    s = si.samples(spark, folder)
    torn = F.when(s.seq % 7 == 0, F.substring(line, 1, 25)).otherwise(line)
    base = _scratch(spark)
    s.select(F.explode(F.array(torn, F.lit("  "))).alias("value")).write.text(f"{base}/samples")
    return io.count_malformed(io.require_nonempty(io.read_samples(spark, f"{base}/samples")))


@query("suite_sources", "S7", "SELECT item_id, text, 'data' AS suite_source FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, text, 'fixture' FROM benchmark WHERE item_id % 2 = 1")
def suite_sources(spark, folder):
    """One suite that lies in a folder and one that does not, with the given items as its tagged fallback."""
    b = table(spark, folder, "benchmark").select("item_id", "text")
    base = _scratch(spark)
    b.filter("item_id % 2 = 0").write.json(f"{base}/here")
    nothing = b.filter("item_id % 2 = 1")
    return io.read_suite(spark, f"{base}/here", b.limit(0)).unionByName(io.read_suite(spark, f"{base}/not_here", nothing))


@query("pair_files", "S10", f"""WITH {si.DIALOGUES}, p AS (SELECT trim(user_text) AS r, trim(reply_text) AS c FROM dialogues)
SELECT 'dialogue' AS file, count(*) FILTER (WHERE r <> '' AND c <> '' AND r <> c) AS n, false AS missing FROM p UNION ALL SELECT 'nowhere', 0, true""")
def pair_files(spark, folder):
    """Pairs from a file with broken lines and from one that does not exist, which is skipped and counted."""
    d = si.dialogues(spark, folder)
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("user_text").alias("rejected"), F.col("reply_text").alias("chosen")))
    base = _scratch(spark)
    d.select(F.explode(F.array(line, F.lit("{broken"))).alias("value")).write.text(f"{base}/pairs")
    parts, missing = io.read_pairs(spark, {"dialogue": f"{base}/pairs", "nowhere": f"{base}/nowhere"})
    n = pr.pair_counts(pr.union_pairs(parts)).groupBy("file").agg(F.sum("n").alias("n")).withColumn("missing", F.lit(False))
    gone = spark.createDataFrame([(m, 0, True) for m in missing], "file string, n long, missing boolean")
    return n.unionByName(gone)


@query("warehouse_tables", "S16", """SELECT 'audit_log' AS name, count(*) AS n, count(DISTINCT user_id % 9) AS n_shops FROM events UNION ALL
SELECT 'tickets', count(*), count(DISTINCT conv_id % 4) FROM (SELECT DISTINCT conv_id FROM conversations)""")
def warehouse_tables(spark, folder):
    """Operational tables written and read back by their declared schemas."""
    base = _scratch(spark)
    none = lambda t: F.lit(None).cast(t)
    e, c = table(spark, folder, "events"), table(spark, folder, "conversations").select("conv_id").distinct()
    made = {
        "audit_log": e.select(F.col("event_id").cast("bigint").alias("id"), (F.col("user_id") % 9).cast("int").alias("shop_id"), F.lit("system").alias("actor"), F.col("event_type").alias("action"),
                              F.col("props").alias("details"), F.col("ts").cast("timestamp").alias("created_at")),
        "tickets": c.select(F.col("conv_id").cast("bigint").alias("id"), (F.col("conv_id") % 4).cast("int").alias("shop_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("handover").alias("reason"),
                            F.lit("open").alias("status"), none("string").alias("assigned_to"), none("timestamp").alias("created_at"), none("timestamp").alias("resolved_at")),
    }
    counts = []
    for name, df in made.items():
        df.write.parquet(f"{base}/{name}")
        back = io.read_table(spark, name, f"{base}/{name}")
        if back.schema != sc.warehouse_schemas()[name]:
            raise ValueError(f"{name} has not its declared schema")
        counts.append(back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct("shop_id").alias("n_shops")))
    return counts[0].unionByName(counts[1])


@query("trace_files", "S9", f"""{_S} SELECT CAST(count(DISTINCT (session_id, date_trunc('day', ts))) AS BIGINT) AS n_sessions, count(*) AS n_steps, 8 AS n_files FROM steps""")
def trace_files(spark, folder):
    """Traces of as many sessions as there are users and days, in eight files."""
    day = F.date_format("ts", "yyyy-MM-dd")
    s = si.steps(spark, folder).withColumns({"session_id": F.concat_ws("/", F.col("session_id").cast("string"), day), "idx": F.col("idx").cast("int")})
    base = _scratch(spark)
    io.write_traces(s, f"{base}/traces", files=8)
    back = io.read_traces(spark, f"{base}/traces").agg(F.countDistinct("session_id").alias("n_sessions"), F.count(F.lit(1)).alias("n_steps"))
    files = spark.read.text(f"{base}/traces").select(F.col("_metadata.file_path").alias("f")).agg(F.countDistinct("f").cast("int").alias("n_files"))
    return one_row(back, files)


@query("sft_round_trip", "S5 W4", f"""WITH {si.SAMPLES}, r AS (SELECT id, intent, row_number() OVER (PARTITION BY intent, image_type ORDER BY md5('42|' || id), id) AS rn, count(*) OVER (PARTITION BY intent, image_type) AS n FROM samples),
 c AS (SELECT *, CASE WHEN n >= 5 THEN greatest(1, n // 10) ELSE 0 END AS k FROM r) SELECT CASE WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'val' ELSE 'train' END AS split, intent, count(*) AS n FROM c GROUP BY ALL""")
def sft_round_trip(spark, folder):
    from ..operators import packing as pk
    rows = pk.to_sharegpt(pk.stratified_split(si.samples(spark, folder)), lx.SYSTEM_PROMPT)
    base = _scratch(spark)
    io.write_sft(rows, f"{base}/sft")
    return spark.read.schema(rows.schema).json(f"{base}/sft").groupBy("split", "intent").agg(F.count(F.lit(1)).alias("n"))
