"""Queries: traces, guards, agent runs, orders, usage, shop events and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import rules as ru, shop as sh, text as tx
from ..operators import agent as ag, retrieval as rt, usage as us
from ..sources import io
from ..streaming import ingest as ing
from . import standins as si
from .registry import query, table

_S = f"WITH {si.STEPS}"


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- traces and guards ----

@query("trace_summary", "A31", _S + """ SELECT session_id, count(*) AS n_steps, round(sum(ms), 6) AS total_ms, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, CAST(sum(out_tokens) AS BIGINT) AS out_tokens, round(sum(cost), 6) AS cost,
  count(*) FILTER (WHERE NOT ok) AS n_failures, count(*) FILTER (WHERE action <> 'continue') AS n_blocked, coalesce(bool_or(action IN ('abort', 'escalate')), false) AS aborted FROM steps GROUP BY session_id""")
def trace_summary(spark, folder):
    return _round(ag.trace_summary(si.steps(spark, folder)), "total_ms", "cost")


@query("guard_trip_rate", "A31", _S + ", s AS (SELECT session_id, turn, coalesce(bool_or(action IN ('abort', 'escalate')), false) AS a FROM steps GROUP BY session_id, turn) SELECT count(*) AS n_sessions, round(avg(a::INT), 6) AS trip_rate FROM s")
def guard_trip_rate(spark, folder):
    return _round(ag.guard_trip_rate(ag.trace_summary(si.steps(spark, folder), ("session_id", "turn"))), "trip_rate")


@query("top_steps", "W7", _S + ", r AS (SELECT session_id, seq, ms, row_number() OVER (PARTITION BY session_id ORDER BY ms DESC, seq) AS rank FROM steps) SELECT session_id, seq, ms, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def top_steps(spark, folder):
    return ag.top_steps(si.steps(spark, folder)).select("session_id", "seq", "ms", "rank")


@query("repeat_actions", "W8", _S + """, r AS (SELECT session_id, seq, action_key, list(action_key) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev FROM steps),
 c AS (SELECT session_id, seq, coalesce(len(list_filter(prev, lambda k: k = action_key)), 0)::INTEGER AS same FROM r) SELECT session_id, seq, same, same >= 1 AS abort FROM c""")
def repeat_actions(spark, folder):
    return ag.repeat_actions(si.steps(spark, folder)).select("session_id", "seq", "same", "abort")


LIMITS = {"steps": 2, "tools": 1, "wall_s": 20000.0, "cost": 0.05, "tokens": 4000, "turns": 20, "repeat": 2}


@query("guardrail_replay", "W9", _S + """, a AS (SELECT *, row_number() OVER t AS n, sum((kind = 'tool')::INT) OVER t - (kind = 'tool')::INT AS tools, min(ts) OVER (PARTITION BY session_id, turn) AS t0, sum(cost) OVER s - cost AS c, sum(in_tokens + out_tokens) OVER s - in_tokens - out_tokens AS tk,
   dense_rank() OVER (PARTITION BY session_id ORDER BY turn) AS turns FROM steps WINDOW t AS (PARTITION BY session_id, turn ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
SELECT session_id, seq, CASE WHEN n > 2 THEN 'steps' WHEN tools > 1 THEN 'tools' WHEN epoch(ts) - epoch(t0) > 20000 THEN 'wall_clock' WHEN c > 0.05 THEN 'cost' WHEN tk > 4000 THEN 'tokens' WHEN turns > 20 THEN 'turns' END AS gate FROM a""")
def guardrail_replay(spark, folder):
    # limits scaled to this log, in which a turn is one day of a user
    return ag.guardrail_replay(si.steps(spark, folder), LIMITS).select("session_id", "seq", "gate")


@query("agent_loop_guards", "W10", _S + """, a AS (SELECT *, row_number() OVER t AS n, sum(in_tokens + out_tokens) OVER t - in_tokens - out_tokens AS used, row_number() OVER (PARTITION BY session_id, turn, action_key ORDER BY ts, seq) - 1 AS seen FROM steps
   WINDOW t AS (PARTITION BY session_id, turn ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) SELECT session_id, seq, CASE WHEN n > 4 THEN 'max_steps' WHEN used > 2500 THEN 'token_cap' WHEN seen >= 1 THEN 'repeat' END AS verdict FROM a""")
def agent_loop_guards(spark, folder):
    s = si.steps(spark, folder).withColumn("signature", F.col("action_key"))
    return ag.agent_loop_guards(s, {"steps": 4, "tokens": 2500, "repeat": 1}).select("session_id", "seq", "verdict")


@query("last_user_message", "W13", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, folder):
    return ag.last_user_message(table(spark, folder, "conversations"))


@query("slot_state", "W14", "SELECT user_id AS session_id, event_type AS slot, arg_max(props, (ts, event_id)) AS value, count(*) AS n_writes FROM events GROUP BY ALL")
def slot_state(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("slot"), F.col("props").alias("value"), "ts", F.col("event_id").alias("seq"))
    return ag.slot_state(e)


@query("visual_context", "P12", """WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> 'system')
SELECT conv_id, substr(string_agg('[图' || i || '] ' || text, '；' ORDER BY i), 1, 400) AS context FROM r GROUP BY conv_id""")
def visual_context(spark, folder):
    c = table(spark, folder, "conversations").filter("role <> 'system'")
    return ag.visual_context(c, key="conv_id", seq="turn", text="text")


@query("idempotency_keys", "P8", """WITH e AS (SELECT event_id, user_id::VARCHAR || '|' || event_type || '|' || '{"a":"' || event_type || '","n":{"k":"' || regexp_extract(props, '[0-9]+') || '","list":[1,{"x":true,"y":null}]}}' AS call FROM events)
SELECT sha256(call)[1:16] AS key, count(*) AS n, min(event_id) AS first_event FROM e GROUP BY 1""")
def idempotency_keys(spark, folder):
    e = table(spark, folder, "events")
    k = F.concat(F.lit('"k": "'), F.regexp_extract("props", "[0-9]+", 0), F.lit('"'))
    a, inner = F.concat(F.lit('"a":"'), F.col("event_type"), F.lit('"')), F.lit('"list": [1, {"y": null, "x": true}]')
    first = F.concat(F.lit("{"), a, F.lit(', "n": {'), inner, F.lit(","), k, F.lit("}}"))
    second = F.concat(F.lit('{"n":{'), k, F.lit(","), inner, F.lit("}, "), a, F.lit("}"))
    args = F.when(F.col("event_id") % 2 == 0, first).otherwise(second)  # two orders of the same arguments
    return e.groupBy(tx.idempotency_key(F.col("user_id").cast("string"), F.col("event_type"), args).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("undeclared_arguments", "L6", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'k' ELSE '' END AS kept, CASE WHEN event_type IN ('click', 'view') THEN 't' ELSE 'k,t' END AS dropped FROM events""")
def undeclared_arguments(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.create_map(F.lit("t"), F.col("event_type"), F.lit("k"), F.col("props")).alias("args"))
    declared = spark.createDataFrame([("click", ["k"]), ("view", ["k", "z"]), ("purchase", ["z"])], "tool string, params array<string>")
    u = ag.undeclared_arguments(e, declared)
    return u.select(F.col("id").alias("event_id"), F.array_join(F.map_keys("clean_args"), ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


# ---- agent runs: one run per order, its lines are the tool calls ----

_VERBS = "['lookup_order', 'check_stock', 'start_return', 'final_answer']"
_RUNS = f"""calls AS (SELECT l_orderkey AS tid, list({_VERBS}[l_partkey % 4 + 1] ORDER BY l_linenumber, l_partkey, l_suppkey) AS called, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS last_flag FROM lineitem GROUP BY l_orderkey),
 j AS (SELECT o_orderkey AS tid, o_orderstatus AS st, o_totalprice / 1000 AS latency_ms, CASE WHEN o_orderkey % 31 = 0 THEN 'boom' ELSE '' END AS error, coalesce(called, []::VARCHAR[]) AS called, last_flag, o_custkey AS cust, o_orderpriority AS reply,
   CASE WHEN o_orderstatus = 'F' THEN ['lookup_order'] WHEN o_orderstatus = 'O' THEN ['check_stock', 'lookup_order'] ELSE []::VARCHAR[] END AS want, CASE WHEN o_orderkey % 2 = 0 THEN ['start_return'] ELSE []::VARCHAR[] END AS forbid FROM orders LEFT JOIN calls ON o_orderkey = tid),
 k AS (SELECT *, error <> '' AS bad, CASE st WHEN 'F' THEN list_contains(called, 'lookup_order') WHEN 'O' THEN contains(reply, 'HIGH') OR contains(reply, 'LOW') ELSE cust % 2 = 0 END AS v FROM j),
 m AS (SELECT tid, NOT bad AND v AS success, CASE WHEN bad THEN 'exception' WHEN v THEN 'ok' WHEN st = 'F' THEN 'not_called' WHEN st = 'O' THEN 'not_mentioned' ELSE 'state_unchanged' END AS reason, CASE WHEN bad THEN 0 ELSE len(called) END::INTEGER AS n_steps,
   NOT bad AND list_has_all(called, want) AND NOT list_has_any(called, forbid) AS tool_selection_ok, NOT bad AND (st <> 'F' OR coalesce(last_flag = 'A', false)) AS slot_filling_ok,
   CASE WHEN bad THEN 0 ELSE len(list_filter(called, lambda c: NOT list_contains(want, c) AND c <> 'final_answer')) END::INTEGER AS unnecessary_calls, latency_ms, CASE WHEN bad THEN 0 ELSE cust END AS n_tokens_in, CASE WHEN bad THEN 0 ELSE cust % 100 END AS n_tokens_out, error FROM k)"""


def _metrics(spark, folder):
    li = table(spark, folder, "lineitem")
    verbs = F.array(*[F.lit(v) for v in ("lookup_order", "check_stock", "start_return", "final_answer")])
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.get(verbs, (F.col("l_partkey") % 4).cast("int")).alias("verb"), "l_returnflag")
    as_call = lambda r: F.struct(r["verb"].alias("action"), F.create_map(F.lit("flag"), r["l_returnflag"]).alias("action_input"), F.lit(True).alias("success"))
    calls = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x")).select(F.col("l_orderkey").alias("tid"), F.transform("x", as_call).alias("tool_calls"))
    o = table(spark, folder, "orders")
    st, none = F.col("o_orderstatus"), F.array().cast("array<string>")
    tasks = o.select(F.col("o_orderkey").alias("tid"), F.when(st == "F", F.array(F.lit("lookup_order"))).when(st == "O", F.array(F.lit("check_stock"), F.lit("lookup_order"))).otherwise(none).alias("expected_tools"),
                     F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("start_return"))).otherwise(none).alias("forbidden_tools"),
                     F.when(st == "F", F.create_map(F.lit("flag"), F.lit("A"))).otherwise(F.create_map().cast("map<string,string>")).alias("expected_slots"),
                     F.when(st == "F", F.lit("tool_called")).when(st == "O", F.lit("answered_contains")).otherwise(F.lit("state_changed")).alias("verifier"),
                     F.when(st == "F", F.array(F.lit("lookup_order"))).when(st == "O", F.array(F.lit("HIGH"), F.lit("LOW"))).otherwise(F.array(F.lit("ticket"))).alias("verifier_args"))
    runs = o.select(F.col("o_orderkey").alias("tid"), F.col("o_orderpriority").alias("reply"), F.create_map(F.lit("ticket"), F.when(F.col("o_custkey") % 2 == 0, F.lit("1")).otherwise(F.lit(""))).alias("state"),
                    (F.col("o_totalprice") / 1000).alias("latency_ms"), F.when(F.col("o_orderkey") % 31 == 0, F.lit("boom")).otherwise(F.lit("")).alias("error"), F.col("o_custkey").alias("tokens_in"), (F.col("o_custkey") % 100).alias("tokens_out"))
    runs = runs.join(calls, "tid", "left").withColumn("n_steps", F.when(F.col("tool_calls").isNull(), 0).otherwise(F.size("tool_calls")))
    return ag.score_agent_tasks(tasks, runs)


@query("score_agent_tasks", "J22 U3", f"WITH {_RUNS} SELECT * FROM m")
def score_agent_tasks(spark, folder):
    return _metrics(spark, folder).drop("tools_called")


@query("agent_summary", "A24", f"""WITH {_RUNS}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS c FROM m)
SELECT count(*) AS n, round(avg(success::INT), 6) AS success_rate, round(avg(tool_selection_ok::INT), 6) AS tool_selection_rate, round(avg(slot_filling_ok::INT), 6) AS slot_filling_rate, round(avg(n_steps) FILTER (WHERE error = ''), 6) AS mean_steps,
  CAST(sum(unnecessary_calls) AS BIGINT) AS unnecessary, CAST(sum(n_tokens_in) AS BIGINT) AS tokens_in, CAST(sum(n_tokens_out) AS BIGINT) AS tokens_out, round(CAST(sum(n_tokens_in) AS DOUBLE) / 1000 * 0.001 + CAST(sum(n_tokens_out) AS DOUBLE) / 1000 * 0.003, 6) AS cost,
  (SELECT round(max(latency_ms) FILTER (WHERE i = least(c // 2, c - 1)), 6) FROM r) AS p50, (SELECT round(max(latency_ms) FILTER (WHERE i = least(CAST(floor(c * 0.95) AS BIGINT), c - 1)), 6) FROM r) AS p95 FROM m""")
def agent_summary(spark, folder):
    from ..session import cut_lineage
    return _round(ag.agent_summary(cut_lineage(_metrics(spark, folder))), "success_rate", "tool_selection_rate", "slot_filling_rate", "mean_steps", "cost", "p50", "p95")


@query("agent_failure_causes", "A25", f"""WITH {_RUNS} SELECT CASE WHEN error <> '' THEN '执行异常' WHEN NOT tool_selection_ok THEN '工具选择错' WHEN reason IN ('not_mentioned', 'not_called') THEN '能力不足' ELSE '其他' END AS cause, count(*) AS n FROM m WHERE NOT success GROUP BY 1""")
def agent_failure_causes(spark, folder):
    return ag.agent_failure_causes(_metrics(spark, folder))


# ---- orders and stock ----

_PHRASE = "CASE status WHEN 'shipped' THEN '运输中，承运商 ' || carrier || '，单号 ' || tracking WHEN 'delivered' THEN '已签收（' || CAST(delivered_at AS VARCHAR) || '）' WHEN 'pending' THEN '还未发货' ELSE status END"


@query("order_status", "J18 X23", f"""WITH {si.ORDERS}, p AS (SELECT order_id, session_id, {_PHRASE} AS phrase FROM shop_orders), f AS (SELECT session_id, min(order_id) AS order_id, arg_min(phrase, order_id) AS phrase FROM p GROUP BY session_id),
 r AS (SELECT event_id AS request_id, user_id AS session_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 2 END AS oid FROM events)
SELECT request_id, CASE WHEN oid IS NOT NULL THEN p.order_id ELSE f.order_id END AS order_id, CASE WHEN oid IS NOT NULL THEN p.phrase ELSE f.phrase END AS status,
  CASE WHEN oid IS NOT NULL AND p.order_id IS NULL THEN 'ORDER_NOT_FOUND' WHEN oid IS NULL AND f.order_id IS NULL THEN 'NO_ORDER_IN_SESSION' END AS error_code FROM r LEFT JOIN p ON r.oid = p.order_id LEFT JOIN f ON r.session_id = f.session_id""")
def order_status(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 2).alias("order_id"))
    return ag.order_status(e, si.shop_orders(spark, folder))


@query("stock_status", "J19", """WITH s AS (SELECT p_name AS sku, CAST(p_size AS VARCHAR) AS size, CAST(max(p_partkey) % 3 AS INTEGER) AS available FROM part GROUP BY p_name, p_size), n AS (SELECT *, CASE WHEN available > 0 THEN '有货' ELSE '缺货，预计 2001-09-28 补货' END AS note FROM s),
 r AS (SELECT event_id, ['small ring', 'red widget', 'blue bolt', 'no such'][event_id % 4 + 1] AS sku, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id % 60 AS VARCHAR) END AS size FROM events)
SELECT r.event_id AS request_id, r.sku, r.size, available, note, CASE WHEN n.sku IS NULL THEN 'SIZE_NOT_FOUND' END AS error_code FROM r LEFT JOIN n ON r.sku = n.sku AND r.size = n.size WHERE r.size <> ''
UNION ALL SELECT r.event_id, r.sku, n.size, available, note, CASE WHEN n.sku IS NULL THEN 'SKU_NOT_FOUND' END FROM r LEFT JOIN n ON r.sku = n.sku WHERE r.size = ''""")
def stock_status(spark, folder):
    p = table(spark, folder, "part")
    stock = p.groupBy(F.col("p_name").alias("sku"), F.col("p_size").cast("string").alias("size")).agg((F.max("p_partkey") % 3).cast("int").alias("available")).withColumn("restock_date", F.lit("2001-09-28"))
    names = F.array(*[F.lit(s) for s in ("small ring", "red widget", "blue bolt", "no such")])
    i = F.col("event_id")
    req = table(spark, folder, "events").select(i.alias("request_id"), F.get(names, (i % 4).cast("int")).alias("sku"), F.when(i % 5 == 0, F.lit("")).otherwise((i % 60).cast("string")).alias("size"))
    return ag.stock_status(req, stock)


@query("return_eligibility", "J20 X23", f"""WITH {si.ORDERS}, d AS (SELECT *, CASE WHEN status = 'delivered' THEN CAST(date_diff('day', delivered_at, DATE '{si.AS_OF}') AS INTEGER) END AS days FROM shop_orders)
SELECT order_id, coalesce(days <= 7, false) AS eligible, days, CASE WHEN days <= 7 THEN 7 - days END AS remaining_days, CASE WHEN days <= 7 THEN 'in_window' WHEN days IS NOT NULL THEN 'too_late' ELSE 'not_delivered:' || status END AS why, coalesce(days <= 7, false) OR order_id % 10 = 0 AS can_file FROM d""")
def return_eligibility(spark, folder):
    o = si.shop_orders(spark, folder)
    return ag.return_eligibility(o, F.lit(si.AS_OF).cast("date"), reason=F.when(F.col("order_id") % 10 == 0, F.lit("质量问题")).otherwise(F.lit("不喜欢")))


@query("link_orders", "J27", """WITH o AS (SELECT event_id AS order_id, user_id AS customer, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT event_id AS session_id, user_id AS customer, ts FROM events WHERE event_type = 'view')
SELECT o.order_id, o.customer, (SELECT arg_max(session_id, (ts, session_id)) FROM s WHERE s.customer = o.customer AND s.ts <= o.ts) AS session_id FROM o""")
def link_orders(spark, folder):
    e = table(spark, folder, "events")
    o = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), F.col("user_id").alias("customer"), "ts")
    s = e.filter("event_type = 'view'").select(F.col("event_id").alias("session_id"), F.col("user_id").alias("customer"), "ts")
    return ag.link_orders(o, s)


@query("flatten_orders", "S12", """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, round(o_totalprice, 4) AS amount, o_orderstatus AS financial_status,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines, (SELECT coalesce(sum(l_quantity), 0)::BIGINT FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity FROM orders""")
def flatten_orders(spark, folder):
    li = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_partkey").cast("string").alias("sku"))).alias("nodes"))
    o = table(spark, folder, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gid = lambda kind, c: F.concat(F.lit(f"gid://shop/{kind}/"), c.cast("string"))
    raw = o.select(F.to_json(F.struct(
        gid("Order", F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("displayFinancialStatus"), F.struct(gid("Customer", F.col("o_custkey")).alias("id")).alias("customer"),
        F.struct(F.struct(F.col("o_totalprice").cast("string").alias("amount")).alias("shopMoney")).alias("totalPriceSet"), F.struct("nodes").alias("lineItems"))).alias("payload"))
    orders, lines, _ = io.flatten_orders(raw)
    per = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("quantity"))
    return orders.join(per, "order_id", "left").select("order_id", "customer_id", F.round(F.col("amount").cast("double"), 4).alias("amount"), "financial_status",
                                                       F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("quantity", F.lit(0)).alias("quantity"))


_CHG = """chg AS (SELECT 's' || CAST(p_size % 5 AS VARCHAR) AS shop, p_name || CAST(p_partkey % 40 AS VARCHAR) AS id, p_partkey AS seq, p_retailprice AS price, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST(p_partkey * 7919 % 1000 AS INTEGER) AS updated_at, p_partkey % 9 = 0 AS deleted FROM part)"""


def _changes(spark, folder):
    p, k = table(spark, folder, "part"), F.col("p_partkey")
    return p.select(F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")).alias("shop"), F.concat(F.col("p_name"), (k % 40).cast("string")).alias("id"), k.alias("seq"), F.col("p_retailprice").alias("price"),
                    F.timestamp_seconds(F.lit(1704067200) + (k * 7919 % 1000) * 60).alias("updated_at"), (k % 9 == 0).alias("deleted"))


@query("latest_products", "W16 T4", f"WITH {_CHG}, r AS (SELECT *, row_number() OVER (PARTITION BY shop, id ORDER BY updated_at DESC, seq DESC) AS rn FROM chg) SELECT shop, id, seq, price FROM r WHERE rn = 1 AND NOT deleted")
def latest_products(spark, folder):
    return us.latest_products(_changes(spark, folder)).select("shop", "id", "seq", "price")


@query("flatten_products", "S11", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS category, p_brand AS vendor, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS n_images, CAST(p_size AS VARCHAR) AS size_option FROM part")
def flatten_products(spark, folder):
    p = table(spark, folder, "part")
    gid = lambda kind: F.concat(F.lit(f"gid://shop/{kind}/"), F.col("p_partkey").cast("string"))
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://img/"), F.col("p_partkey").cast("string"))).otherwise(F.lit(""))
    opt = F.array(F.struct(F.lit("Size").alias("name"), F.col("p_size").cast("string").alias("value")))
    raw = p.select(F.to_json(F.struct(gid("Product").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("productType"), F.col("p_brand").alias("vendor"),
                                      F.struct(F.array(F.struct(url.alias("url"))).alias("nodes")).alias("images"), F.struct(F.array(F.struct(gid("Variant").alias("id"), opt.alias("selectedOptions"))).alias("nodes")).alias("variants"))).alias("payload"))
    f = io.flatten_products(raw)
    return f.select("id", "title", "category", "vendor", F.size("image_urls").alias("n_images"), F.try_element_at(F.get("variants", F.lit(0))["options"], F.lit("Size")).alias("size_option"))


# ---- logs ----

_LOG = "log AS (SELECT ts, CAST(user_id % 5 AS BIGINT) AS concurrency, value AS ms, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'e' || CAST(user_id % 3 AS VARCHAR) END AS error, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS tokens FROM events)"


def _log(spark, folder):
    e = table(spark, folder, "events")
    return e.select("ts", (F.col("user_id") % 5).alias("concurrency"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"),
                    F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string"))).alias("error"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("tokens"), F.col("value").alias("ttft_ms"))


_LOAD = f"""WITH {_LOG}, s AS (SELECT concurrency, count(*) AS n_done, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_fail, epoch(max(ts)) - epoch(min(ts)) AS wall_s, avg(ms) FILTER (WHERE ok) AS mean, count(*) / (epoch(max(ts)) - epoch(min(ts))) AS qps,
  quantile_cont(ms, 0.5) FILTER (WHERE ok) AS p50, quantile_cont(ms, 0.95) FILTER (WHERE ok) AS p95, quantile_cont(ms, 0.99) FILTER (WHERE ok) AS p99 FROM log GROUP BY concurrency)"""


@query("load_summary", "A29", _LOAD + " SELECT concurrency, n_done, n_ok, n_fail, round(wall_s, 3) AS wall_s, round(mean, 6) AS mean, round(qps, 9) AS qps, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM s")
def load_summary(spark, folder):
    s = ag.load_summary(_log(spark, folder), ["concurrency"])
    return _round(s.withColumn("wall_s", F.round("wall_s", 3)).withColumn("qps", F.round("qps", 9)), "mean", "p50", "p95", "p99")


@query("best_concurrency", "A29", _LOAD + " SELECT arg_max(concurrency, qps) AS best, round(max(qps), 9) AS qps FROM s")
def best_concurrency(spark, folder):
    return ag.best_concurrency(ag.load_summary(_log(spark, folder), ["concurrency"]), "concurrency").withColumn("qps", F.round("qps", 9))


@query("load_errors", "A29", f"WITH {_LOG} SELECT concurrency, error, count(*) AS n FROM log WHERE NOT ok GROUP BY ALL")
def load_errors(spark, folder):
    return ag.load_errors(_log(spark, folder), ["concurrency"])


@query("generation_latency", "A30", f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY concurrency ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY concurrency) AS c FROM log)
SELECT concurrency, count(*) AS n_ok, round(sum(tokens) / (epoch(max(ts)) - epoch(min(ts))), 6) AS tokens_per_s, max(ms) FILTER (WHERE i = least(c // 2, c - 1)) AS ttft_p50, max(ms) FILTER (WHERE i = least(CAST(floor(c * 0.95) AS BIGINT), c - 1)) AS ttft_p95 FROM r GROUP BY concurrency""")
def generation_latency(spark, folder):
    return _round(ag.generation_latency(_log(spark, folder), ["concurrency"]), "tokens_per_s")


@query("unit_economics", "A34", _LOAD + """, q AS (SELECT max(qps) * 1000 AS qps FROM s), g AS (SELECT CAST(p_partkey AS VARCHAR) AS label, 1.88 * (1 + p_size / 100.0) AS gpu, 5.0 + p_partkey % 4 AS peak, p_retailprice / 10 AS price, 500 + p_partkey % 1500 AS quota FROM part),
 m AS (SELECT label, gpu / (qps / peak * 3600) AS c, price / quota AS r, (price * 0.85 - gpu / (qps / peak * 3600) * quota) / (price * 0.85) AS margin, price FROM g, q)
SELECT label, round(c, 9) AS gpu_per_session, round(r, 6) AS revenue_per_session, round(margin, 6) AS margin, CAST(floor(300.0 / greatest(price * margin, 1.0)) + 1 AS BIGINT) AS breakeven_shops FROM m""")
def unit_economics(spark, folder):
    qps = ag.load_summary(_log(spark, folder), ["concurrency"]).agg((F.max("qps") * 1000).alias("qps"))
    k = F.col("p_partkey")
    grid = table(spark, folder, "part").select(k.cast("string").alias("label"), (1.88 * (1 + F.col("p_size") / 100.0)).alias("gpu_hourly"), (5.0 + k % 4).alias("peak"), (F.col("p_retailprice") / 10).alias("price"),
                                               (500 + k % 1500).alias("quota"), F.lit(0.15).alias("cut"), F.lit(300.0).alias("infra_monthly"))
    u = ag.unit_economics(qps, grid)
    return _round(u.withColumn("gpu_per_session", F.round("gpu_per_session", 9)), "revenue_per_session", "margin")


_TRAIN = "logs AS (SELECT user_id AS run, event_id AS step, CASE WHEN event_type <> 'view' THEN 5.0 + value / (1 + event_id % 50) END AS loss, CASE WHEN event_type = 'view' THEN value / 10 END AS eval_loss, CASE WHEN event_type = 'click' THEN value / 40 END AS grad_norm FROM events)"


@query("train_diagnostics", "A32 S8", f"""WITH {_TRAIN}, l AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS z, count(*) OVER (PARTITION BY run) AS n FROM logs WHERE loss IS NOT NULL),
 h AS (SELECT run, any_value(n) AS n, avg(loss) FILTER (WHERE a <= 5) AS head, avg(loss) FILTER (WHERE z <= 5) AS tail, stddev_samp(loss) FILTER (WHERE z <= 10) AS sd, avg(loss) FILTER (WHERE z <= 10) AS m10 FROM l GROUP BY run),
 e AS (SELECT run, max(eval_loss) FILTER (WHERE z = 1) AS e1, max(eval_loss) FILTER (WHERE z = 2) AS e2 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS z FROM logs WHERE eval_loss IS NOT NULL) GROUP BY run),
 g AS (SELECT run, max(grad_norm) AS mx, avg(grad_norm) AS av, avg(grad_norm) FILTER (WHERE a > n // 2) AS late FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS a, count(*) OVER (PARTITION BY run) AS n FROM logs WHERE grad_norm IS NOT NULL) GROUP BY run),
 j AS (SELECT r.run, h.*EXCLUDE (run), e1, e2, mx, av, late FROM (SELECT DISTINCT run FROM logs) r LEFT JOIN h ON r.run = h.run LEFT JOIN e ON r.run = e.run LEFT JOIN g ON r.run = g.run),
 c AS (SELECT run, unnest([CASE WHEN n IS NULL THEN 'no_loss' END, CASE WHEN n >= 10 THEN CASE WHEN (head - tail) / head < 0.03 THEN 'loss_flat' WHEN (head - tail) / head > 0.7 THEN 'loss_too_fast' ELSE 'loss_ok' END END, CASE WHEN n >= 20 AND sd > 0.15 * m10 THEN 'tail_noisy' END,
   CASE WHEN n IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN e1 > e2 * 1.02 THEN 'eval_rising' ELSE 'eval_ok' END END, CASE WHEN n IS NOT NULL AND mx IS NOT NULL THEN CASE WHEN mx > 10 THEN 'grad_explodes' WHEN late > av * 1.5 THEN 'grad_rises_late' ELSE 'grad_ok' END END]) AS code FROM j)
SELECT run, code FROM c WHERE code IS NOT NULL""")
def train_diagnostics(spark, folder):
    e = table(spark, folder, "events")
    v, t = F.col("value"), F.col("event_type")
    log = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(t != "view", 5.0 + v / (1 + F.col("event_id") % 50)).alias("loss"), F.when(t == "view", v / 10).alias("eval_loss"),
                   F.when(t == "click", v / 40).alias("grad_norm"))
    return ag.train_diagnostics(log)


@query("train_log_entries", "S8", "SELECT user_id AS run, event_id AS step, value AS loss FROM events WHERE event_type <> 'signup'")
def train_log_entries(spark, folder):
    e = table(spark, folder, "events")
    line = F.when(F.col("event_type") == "signup", F.lit("noise {'epoch': 1}")).otherwise(
        F.format_string("step log {'loss': %s, 'step': %s, 'epoch': 0.5} tail", F.col("value").cast("string"), F.col("event_id").cast("string")))
    return io.train_log_entries(e.select(F.col("user_id").alias("run"), line.alias("value"))).select("run", "step", "loss")


@query("request_limits", "F23", """WITH r AS (SELECT conv_id, turn, [CASE WHEN turn % 4 = 3 THEN 'data:broken' ELSE 'data:image/png;base64,' || text END, 'http://x', 'data:;base64,' || text, 'y'][1:(turn % 4 + 1)] AS images, length(text) * 3 // 4 AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN len(images) > 3 THEN 'too_many_images' WHEN turn % 4 = 3 THEN 'bad_data_url' WHEN CASE WHEN turn % 4 = 2 THEN 2 * b ELSE b END > 600 THEN 'too_large' END AS reason FROM r""")
def request_limits(spark, folder):
    c = table(spark, folder, "conversations")
    t = F.replace("text", F.lit(","), F.lit(";"))
    imgs = F.slice(F.array(F.when(F.col("turn") % 4 == 3, F.lit("data:broken")).otherwise(F.concat(F.lit("data:image/png;base64,"), t)), F.lit("http://x"), F.concat(F.lit("data:;base64,"), t), F.lit("y")),
                   F.lit(1), (F.col("turn") % 4 + 1).cast("int"))
    return c.select("conv_id", "turn", ru.request_limits(imgs, 3, 600).alias("reason"))


# ---- shop events ----

@query("shop_names", "F24", r"""WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'Shop-' || page_id WHEN 2 THEN ' my' || page_id || '.myshopify.com ' ELSE 'https://a' || page_id || '.myshopify.com:443/x' END AS raw FROM pages),
 l AS (SELECT page_id, lower(trim(raw)) AS s FROM s), h AS (SELECT page_id, CASE WHEN starts_with(s, 'http') AND contains(s, '://') THEN regexp_replace(regexp_replace(s, '^http[^:]*://', ''), '[:/?#].*$', '') ELSE s END AS s FROM l),
 n AS (SELECT page_id, CASE WHEN NOT contains(s, '.') THEN s || '.myshopify.com' ELSE s END AS shop FROM h) SELECT page_id, shop, regexp_matches(shop, '^[a-zA-Z0-9][a-zA-Z0-9\-]*\.myshopify\.com$') AS valid FROM n""")
def shop_names(spark, folder):
    p, i = table(spark, folder, "pages"), F.col("page_id")
    n = i.cast("string")
    raw = (F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("Shop-"), n)).when(i % 4 == 2, F.concat(F.lit(" my"), n, F.lit(".myshopify.com ")))
           .otherwise(F.concat(F.lit("https://a"), n, F.lit(".myshopify.com:443/x"))))
    return p.select("page_id", ru.normalize_shop(raw).alias("shop")).withColumn("valid", ru.valid_shop(F.col("shop")))


_PAD = {n: bytes(b ^ x for b in b"secret".ljust(64, b"\0")) for n, x in (("i", 0x36), ("o", 0x5C))}
_HEX = {n: v.hex() for n, v in _PAD.items()}


@query("body_signatures", "F25", f"""SELECT event_id, base64(unhex(sha256(unhex('{_HEX['o']}') || unhex(sha256(unhex('{_HEX['i']}') || encode(props)))))) AS signature, event_id % 3 <> 0 AS valid FROM events""")
def body_signatures(spark, folder):
    e = table(spark, folder, "events")
    body = F.encode("props", "utf-8")
    sig = sh.body_signature(body, "secret")
    given = F.when(F.col("event_id") % 3 == 0, F.lit("forged")).otherwise(sig)
    return e.select("event_id", sig.alias("signature"), sh.valid_body(body, given, "secret").alias("valid"))


_WEB = "web AS (SELECT CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(event_id // 3 AS VARCHAR) END AS webhook_id, ['PRODUCTS_UPDATE', 'orders/create', 'shop_redact', 'carts/update', 'refunds/create'][user_id % 5 + 1] AS topic FROM events)"


@query("dedup_events", "T2 S15", f"WITH {_WEB} SELECT webhook_id, count(*) AS n FROM (SELECT DISTINCT webhook_id FROM web WHERE webhook_id <> '' UNION ALL SELECT webhook_id FROM web WHERE webhook_id = '') GROUP BY webhook_id")
def dedup_events(spark, folder):
    return ing.dedup_events(_webhooks(spark, folder)).groupBy("webhook_id").agg(F.count(F.lit(1)).alias("n"))


def _webhooks(spark, folder):
    e = table(spark, folder, "events")
    topics = F.array(*[F.lit(t) for t in ("PRODUCTS_UPDATE", "orders/create", "shop_redact", "carts/update", "refunds/create")])
    return e.select(F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.floor(F.col("event_id") / 3).cast("string")).alias("webhook_id"), F.get(topics, (F.col("user_id") % 5).cast("int")).alias("topic"),
                    F.col("user_id").cast("string").alias("shop"), F.encode("props", "utf-8").alias("body"), sh.body_signature(F.encode("props", "utf-8"), "secret").alias("signature"), "ts")


@query("topic_counts", "T3", f"WITH {_WEB}, r AS (SELECT replace(lower(topic), '_', '/') AS t FROM web) SELECT CASE WHEN t = 'carts/update' THEN 'unknown' ELSE t END AS route, count(*) AS n FROM r GROUP BY 1")
def topic_counts(spark, folder):
    return ing.topic_counts(_webhooks(spark, folder))


@query("classify_events", "T1 F25", f"WITH {_WEB} SELECT 200 AS status, count(DISTINCT nullif(webhook_id, '')) + count(*) FILTER (WHERE webhook_id = '') AS n FROM web")
def classify_events(spark, folder):
    return ing.classify(_webhooks(spark, folder), "secret").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("trace_rollup", "T9", _S + """ SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_steps, round(sum(ms), 6) AS total_ms, CAST(sum(in_tokens) AS BIGINT) AS in_tokens, count(*) FILTER (WHERE NOT ok) AS n_failures, count(*) FILTER (WHERE action <> 'continue') AS n_blocked FROM steps GROUP BY 1""")
def trace_rollup(spark, folder):
    r = ing.trace_rollup(si.steps(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return _round(r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_steps", "total_ms", "in_tokens", "n_failures", "n_blocked"), "total_ms")


@query("session_rollup", "T10", _S + """, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)), n AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_messages, CAST(sum(in_tokens + out_tokens) AS BIGINT) AS tokens, bool_or(name = 'purchase') AS resolved, bool_or(name = 'error') AS escalated FROM n GROUP BY session_id, s""")
def session_rollup(spark, folder):
    t = si.steps(spark, folder).select("session_id", F.col("ts").cast("timestamp").alias("ts"), "tokens", (F.col("name") == "purchase").alias("resolved"), (F.col("name") == "error").alias("escalated"))
    r = ing.session_rollup(t, "12 hours")
    return r.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


# ---- usage ----

_LEDGER = f"""{si.USAGE}, e AS (SELECT u.*, coalesce(plan, 'free') AS plan, coalesce(subscription_id, '') AS sub, coalesce(capped_amount, 0) AS cap, CASE coalesce(plan, 'free') WHEN 'free' THEN 5 WHEN 'standard' THEN 10 ELSE 20 END AS included, row_number() OVER (PARTITION BY u.shop, period, key ORDER BY ts, seq) AS kn FROM usage_events u LEFT JOIN subs s ON u.shop = s.shop),
 f AS (SELECT *, cap > 0 AND amount > cap AS big FROM e WHERE kn = 1), o AS (SELECT *, row_number() OVER (PARTITION BY shop, period, big ORDER BY ts, seq) AS r FROM f),
 q AS (SELECT *, CASE WHEN big THEN 'capped' WHEN r <= included THEN 'included' WHEN sub = '' THEN 'no_subscription' WHEN cap = 0 THEN 'charged' END AS early FROM o),
 w AS (SELECT *, row_number() OVER (PARTITION BY shop, period ORDER BY ts, seq) AS i FROM q WHERE early IS NULL),
 fold(shop, period, i, used, took) AS (SELECT shop, period, 0::BIGINT, 0::DECIMAL(18,4), false FROM w GROUP BY shop, period
   UNION ALL SELECT w.shop, w.period, w.i, CASE WHEN fold.used + w.amount <= w.cap THEN fold.used + w.amount ELSE fold.used END::DECIMAL(18,4), fold.used + w.amount <= w.cap FROM fold JOIN w ON fold.shop = w.shop AND fold.period = w.period AND w.i = fold.i + 1),
 firsts AS (SELECT q.seq, q.shop, q.period, q.key, q.amount, coalesce(q.early, CASE WHEN fold.took THEN 'charged' ELSE 'capped' END) AS outcome FROM q LEFT JOIN w ON q.seq = w.seq LEFT JOIN fold ON w.shop = fold.shop AND w.period = fold.period AND w.i = fold.i),
 ledger AS (SELECT e.seq, e.key, e.shop, e.period, CASE WHEN e.seq = x.seq OR x.outcome NOT IN ('included', 'charged') THEN x.outcome ELSE 'duplicate' END AS outcome, CASE WHEN e.seq = x.seq AND x.outcome = 'charged' THEN x.amount ELSE 0 END::DOUBLE AS charged FROM e JOIN firsts x ON e.shop = x.shop AND e.period = x.period AND e.key = x.key)"""


def _ledger(spark, folder):
    return us.usage_ledger(si.usage_events(spark, folder), si.subscriptions(spark, folder), si.PLANS)


@query("usage_ledger", "W11", f"WITH RECURSIVE {_LEDGER} SELECT seq, key, shop, period, outcome, charged FROM ledger")
def usage_ledger(spark, folder):
    return _ledger(spark, folder).withColumn("charged", F.col("charged").cast("double"))


@query("usage_totals", "W11", f"WITH RECURSIVE {_LEDGER} SELECT shop, period, count(*) FILTER (WHERE outcome IN ('included', 'charged')) AS sessions, round(sum(charged), 4) AS usage FROM ledger GROUP BY shop, period")
def usage_totals(spark, folder):
    t = us.ledger_totals(_ledger(spark, folder))
    return t.withColumn("usage", F.round(F.col("usage").cast("double"), 4))


@query("entitlement", "J24", f"""WITH RECURSIVE {_LEDGER}, t AS (SELECT shop, count(*) FILTER (WHERE outcome IN ('included', 'charged')) AS sessions, sum(charged) AS usage FROM ledger GROUP BY shop),
 j AS (SELECT d.shop, coalesce(plan, 'free') AS plan, coalesce(status, 'active') AS status, coalesce(sessions, 0) AS used, coalesce(usage, 0) AS usage, coalesce(capped_amount, 0)::DOUBLE AS cap FROM (SELECT DISTINCT shop FROM usage_events) d LEFT JOIN subs ON d.shop = subs.shop LEFT JOIN t ON d.shop = t.shop),
 r AS (SELECT shop, plan, CASE WHEN status = 'frozen' THEN 'status:frozen' WHEN plan = 'free' AND used >= 5 THEN 'quota_used' WHEN cap > 0 AND usage >= cap THEN 'cap_reached' END AS reason FROM j) SELECT shop, plan, reason IS NULL AS allowed, reason FROM r""")
def entitlement(spark, folder):
    ev = si.usage_events(spark, folder)
    totals = _ledger(spark, folder).groupBy("shop").agg(F.count(F.when(F.col("outcome").isin("included", "charged"), 1)).alias("sessions"), F.sum("charged").alias("usage"))
    return us.entitlement(ev.select("shop").distinct(), si.subscriptions(spark, folder), totals, si.PLANS)


@query("ledger_reconcile", "J23", f"""WITH {si.USAGE}, l AS (SELECT CAST(seq AS VARCHAR) AS key, amount::DOUBLE AS a FROM usage_events WHERE seq % 10 <> 0), r AS (SELECT CAST(seq AS VARCHAR) AS key, (amount + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END)::DOUBLE AS b FROM usage_events WHERE seq % 11 <> 0)
SELECT key, a AS local_amount, b AS reported_amount, CASE WHEN b IS NULL THEN 'not_reported' WHEN a IS NULL THEN 'not_local' ELSE 'amount_differs' END AS problem FROM l FULL JOIN r USING (key) WHERE a IS DISTINCT FROM b""")
def ledger_reconcile(spark, folder):
    u = si.usage_events(spark, folder)
    key = F.col("seq").cast("string").alias("key")
    local = u.filter("seq % 10 <> 0").select(key, "amount")
    rep = u.filter("seq % 11 <> 0").select(key, (F.col("amount") + F.when(F.col("seq") % 7 == 0, 1).otherwise(0)).cast("decimal(11,4)").alias("amount"))
    r = us.ledger_reconcile(local, rep)
    return r.withColumns({c: F.col(c).cast("double") for c in ("local_amount", "reported_amount")})


@query("usage_minute_key", "W12", """SELECT md5('u' || user_id || '|' || CAST(value AS VARCHAR) || '|' || event_type || '|' || CAST(CAST(floor(epoch(ts) / 60) AS BIGINT) AS VARCHAR)) AS key, count(*) AS n FROM events GROUP BY 1""")
def usage_minute_key(spark, folder):
    e = table(spark, folder, "events")
    k = us.usage_minute_key(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("value"), F.col("event_type"), F.col("ts").cast("timestamp"))
    return e.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n"))
