"""Agent runs, traces, guard replays, order and stock look-ups, service and training logs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicons as lx
from ..functions import text as tx
from ..ordering import exact_quantiles, rank_in_groups, running_sums, time_cuts, top_per_group, with_halo
from ..session import one_row, cut_lineage



def _seconds(col: str) -> Column:
    """Epoch seconds of a timestamp with or without time zone."""
    return F.col(col).cast("timestamp").cast("double")


# ---- scoring agent tasks ----


def _verify_tool_called(called: Column, reply: Column, state: Column, args: Column) -> Column:
    return F.array_contains(called, F.get(args, F.lit(0)))


def _verify_answered(called: Column, reply: Column, state: Column, args: Column) -> Column:
    return F.exists(args, lambda k: F.contains(F.coalesce(reply, F.lit("")), k))


def _verify_state(called: Column, reply: Column, state: Column, args: Column) -> Column:
    return F.coalesce(F.try_element_at(state, F.get(args, F.lit(0))), F.lit("")) != ""


VERIFIERS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "tool_called": _verify_tool_called, "answered_contains": _verify_answered, "state_changed": _verify_state}


def score_agent_tasks(tasks: DataFrame, runs: DataFrame, verifiers: Mapping[str, Callable] = VERIFIERS) -> DataFrame:
    """One metric row per run. ``tasks``: tid, expected_tools, forbidden_tools, expected_slots, verifier, verifier_args (array);
    ``runs``: AGENT_RUN. More verifier kinds can be registered as column builders."""
    j = runs.join(tasks.select("tid", "expected_tools", "forbidden_tools", "expected_slots", "verifier", "verifier_args"), "tid")
    calls = F.coalesce("tool_calls", F.array().cast("array<struct<action:string,action_input:map<string,string>,success:boolean>>"))
    j = j.withColumn("called", F.transform(calls, lambda c: c["action"]))
    called, err = F.col("called"), F.coalesce("error", F.lit("")) != ""
    kind = F.lit(None).cast("boolean")
    unknown = F.lit(True)
    for name, build in verifiers.items():
        hit = F.col("verifier") == name
        kind = F.when(hit, F.coalesce(build(called, F.col("reply"), F.col("state"), F.col("verifier_args")), F.lit(False))).otherwise(kind)
        unknown = unknown & ~hit
    ok = ~err & F.coalesce(kind, F.lit(False))
    reason = (F.when(err, F.lit("exception")).when(unknown, F.lit("unknown_verifier")).when(ok, F.lit("ok"))
              .when(F.col("verifier") == "tool_called", F.lit("not_called")).when(F.col("verifier") == "answered_contains", F.lit("not_mentioned"))
              .otherwise(F.lit("state_unchanged")))
    sel = ~err & (F.size(F.array_except("expected_tools", called)) == 0) & ~F.coalesce(F.arrays_overlap("forbidden_tools", called), F.lit(False))
    # later calls win: fold the argument maps, replacing keys
    flat = F.aggregate(calls, F.create_map().cast("map<string,string>"), lambda acc, c: F.map_concat(
        F.map_filter(acc, lambda k, _: ~F.coalesce(F.map_contains_key(c["action_input"], k), F.lit(False))),
        F.coalesce(c["action_input"], F.create_map().cast("map<string,string>"))))
    want = F.map_entries(F.coalesce("expected_slots", F.create_map().cast("map<string,string>")))
    j = j.withColumn("_flat", flat)
    slots = ~err & F.forall(want, lambda e: F.coalesce(F.try_element_at(F.col("_flat"), e["key"]) == e["value"], F.lit(False)))
    extra = F.size(F.filter(called, lambda a: ~F.array_contains(F.col("expected_tools"), a) & (a != "final_answer")))
    return j.select("tid", ok.alias("success"), reason.alias("reason"), F.when(err, 0).otherwise(F.col("n_steps")).alias("n_steps"),
                    F.when(err, F.array().cast("array<string>")).otherwise(called).alias("tools_called"), sel.alias("tool_selection_ok"),
                    slots.alias("slot_filling_ok"), F.when(err, 0).otherwise(extra).alias("unnecessary_calls"), "latency_ms",
                    F.when(err, 0).otherwise(F.col("tokens_in")).alias("n_tokens_in"), F.when(err, 0).otherwise(F.col("tokens_out")).alias("n_tokens_out"),
                    F.coalesce("error", F.lit("")).alias("error"))


def agent_summary(metrics: DataFrame, price_in: float = 0.001, price_out: float = 0.003) -> DataFrame:
    """One row: rates, mean steps of runs without error, index percentiles of latency, tokens and cost."""
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(c.replace("_ok", "") + "_rate")
    base = metrics.agg(F.count(F.lit(1)).alias("n"), rate("success"), rate("tool_selection_ok"), rate("slot_filling_ok"),
                       F.avg(F.when(F.col("error") == "", F.col("n_steps"))).alias("mean_steps"), F.sum("unnecessary_calls").cast("long").alias("unnecessary"),
                       F.sum("n_tokens_in").cast("long").alias("tokens_in"), F.sum("n_tokens_out").cast("long").alias("tokens_out"))
    base = base.withColumn("cost", F.col("tokens_in") / 1000 * price_in + F.col("tokens_out") / 1000 * price_out)
    return one_row(base, exact_quantiles(metrics, [], "latency_ms", {"p50": (0.5, "index"), "p95": (0.95, "index")}))


def agent_failure_causes(metrics: DataFrame) -> DataFrame:
    c = lx.AGENT_CAUSES
    cause = (F.when(F.col("error") != "", F.lit(c["error"])).when(~F.col("tool_selection_ok"), F.lit(c["tool"]))
             .when(F.col("reason").isin("not_mentioned", "not_called"), F.lit(c["ability"])).otherwise(F.lit(c["other"])))
    return metrics.filter(~F.col("success")).groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def undeclared_arguments(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """Call log with undeclared arguments removed and counted. ``calls``: id, tool, args map; ``declared``: tool, params array."""
    j = calls.join(declared, "tool", "left")
    known = F.coalesce(F.col("params"), F.array().cast("array<string>"))
    return j.select("id", "tool", F.map_filter("args", lambda k, _: F.array_contains(known, k)).alias("clean_args"),
                    F.array_sort(F.array_except(F.map_keys("args"), known)).alias("dropped"))


# ---- traces ----

def trace_summary(steps: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Totals per session. A guard step that stops a run is work done by the guard, not a failed step."""
    action = F.try_element_at("detail", F.lit("action"))
    guard = F.col("kind") == "guard"
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum("ms").alias("total_ms"), F.sum("in_tokens").cast("long").alias("in_tokens"),
        F.sum("out_tokens").cast("long").alias("out_tokens"), F.sum("cost").alias("cost"), F.count(F.when(~F.col("ok"), 1)).alias("n_failures"),
        F.count(F.when(guard & ~F.coalesce(action == "continue", F.lit(False)), 1)).alias("n_blocked"),
        F.coalesce(F.bool_or(guard & action.isin("abort", "escalate")), F.lit(False)).alias("aborted"))


def guard_trip_rate(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count(F.lit(1)).alias("n_sessions"), F.avg(F.col("aborted").cast("double")).alias("trip_rate"))


def top_steps(steps: DataFrame, by: str = "ms", n: int = 3, key: str = "session_id", tie: str = "idx") -> DataFrame:
    return top_per_group(steps, [key], [F.col(by).desc(), F.col(tie)], n, "rank")


def repeat_actions(calls: DataFrame, threshold: int = 2, window: int = 6, key: str = "session_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Add ``same`` (equal keys among the previous calls) and ``abort``. ``calls``: session, ts, seq, action_key."""
    wide = with_halo(time_cuts(calls, [key], ts), [key], [F.col(ts), F.col(seq)], F.col("_cut"), window).drop("_cut")
    w = Window.partitionBy(key, "_chunk").orderBy("_rn").rowsBetween(-window, -1)
    seen = wide.withColumn("_prev", F.collect_list("action_key").over(w)).filter(~F.col("_context"))
    same = F.size(F.filter("_prev", lambda k: k == F.col("action_key")))
    return seen.withColumn("same", same).withColumn("abort", same >= threshold - 1).drop("_prev", "_rn", "_chunk", "_context")


def guardrail_replay(steps: DataFrame, limits: Mapping[str, float] = lx.GUARD_LIMITS) -> DataFrame:
    """First gate a step would have tripped, NULL if none. ``steps``: session_id, turn, ts, seq, is_tool, cost, tokens.

    Steps and tool calls are counted inside the turn, cost, tokens and turns inside the session. Tools, cost and tokens
    count what happened *before* the step.
    """
    order, part = [F.col("ts"), F.col("seq")], F.col("_cut")
    steps = cut_lineage(time_cuts(steps.select("session_id", "turn", "ts", "seq", "is_tool", "cost", "tokens"), ["session_id"], "ts"))  # narrow, read by all passes
    in_turn = running_sums(steps, ["session_id", "turn"], order, part, {"steps": F.lit(1), "tools": F.col("is_tool").cast("int")})
    in_turn = in_turn.withColumn("new_turn", (F.col("steps") == 1).cast("int"))
    s = running_sums(in_turn, ["session_id"], order, part, {"cost_sum": F.col("cost"), "token_sum": F.col("tokens"), "turns": F.col("new_turn")})
    start = steps.groupBy("session_id", "turn").agg(F.min("ts").alias("turn_start"))
    s = s.join(start, ["session_id", "turn"])
    elapsed = _seconds("ts") - _seconds("turn_start")
    gate = (F.when(F.col("steps") > limits["steps"], F.lit("steps"))
            .when(F.col("tools") - F.col("is_tool").cast("int") > limits["tools"], F.lit("tools"))
            .when(elapsed > limits["wall_s"], F.lit("wall_clock"))
            .when(F.col("cost_sum") - F.col("cost") > limits["cost"], F.lit("cost"))
            .when(F.col("token_sum") - F.col("tokens") > limits["tokens"], F.lit("tokens"))
            .when(F.col("turns") > limits["turns"], F.lit("turns")))
    return s.select("session_id", "turn", "ts", "seq", gate.alias("gate"))


def agent_loop_guards(steps: DataFrame, limits: Mapping[str, int] = lx.LOOP_LIMITS) -> DataFrame:
    """Audit of logged loops: verdict per step. ``steps``: session_id, turn, ts, seq, signature, tokens."""
    order, part = [F.col("ts"), F.col("seq")], F.col("_cut")
    steps = cut_lineage(time_cuts(steps.select("session_id", "turn", "ts", "seq", "signature", "tokens"), ["session_id"], "ts"))
    s = running_sums(steps, ["session_id", "turn"], order, part, {"n": F.lit(1), "used": F.col("tokens")})
    s = rank_in_groups(s, ["session_id", "turn", "signature"], order, part, "seen")
    verdict = (F.when(F.col("n") > limits["steps"], F.lit("max_steps")).when(F.col("used") - F.col("tokens") > limits["tokens"], F.lit("token_cap"))
               .when(F.col("seen") - 1 >= limits["repeat"], F.lit("repeat")))
    return s.select("session_id", "turn", "ts", "seq", verdict.alias("verdict"))


# ---- conversation state ----

def last_user_message(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    return top_per_group(turns.filter("role = 'user'"), [key], [F.col(turn).desc()], 1, "_rn").select(key, "text")


def slot_state(writes: DataFrame, key: str = "session_id") -> DataFrame:
    """Latest value per slot. ``writes``: session, slot, value, ts, seq."""
    return writes.groupBy(key, "slot").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.count(F.lit(1)).alias("n_writes"))


def visual_context(evidence: DataFrame, max_chars: int = 400, key: str = "session_id", seq: str = "seq", text: str = "description") -> DataFrame:
    """``[图i] description`` parts of a session, joined and cut.

    Every part has at least five characters with its separator, so only the first ``max_chars // 5 + 1`` parts of a session can
    show up; the rank filter drops the rest before anything is collected.
    """
    few = top_per_group(evidence, [key], [F.col(seq)], max_chars // 5 + 1, "_i")
    part = F.struct("_i", F.concat(F.lit("[图"), F.col("_i").cast("string"), F.lit("] "), F.col(text)).alias("p"))
    return few.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("_p")).select(
        key, F.substring(F.array_join(F.transform("_p", lambda x: x["p"]), "；"), 1, max_chars).alias("context"))


# ---- orders and stock ----

def shipping_text(status: Column, carrier: Column, tracking: Column, delivered: Column) -> Column:
    """Customer-facing phrase; an unknown status passes through."""
    fixed = F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in lx.SHIPPING_TEXT.items()])
    return (F.when(status == "shipped", F.concat(F.lit("运输中，承运商 "), carrier, F.lit("，单号 "), tracking))
            .when(status == "delivered", F.concat(F.lit("已签收（"), delivered.cast("string"), F.lit("）"))).otherwise(F.coalesce(fixed, status)))


def order_status(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """request_id, order_id, status, error_code: look-up by order id if given, else the session's first order.

    ``requests``: request_id, session_id, order_id; ``orders``: order_id, session_id, status, carrier, tracking, delivered_at.
    """
    phrase = shipping_text(F.col("status"), F.col("carrier"), F.col("tracking"), F.col("delivered_at"))
    o = orders.select("order_id", "session_id", phrase.alias("phrase"))
    by_id = o.select(F.col("order_id").alias("_oid"), F.col("phrase").alias("p1"))
    first = o.groupBy("session_id").agg(F.min_by(F.struct("order_id", "phrase"), "order_id").alias("f"))
    given = F.coalesce(F.col("order_id").cast("string"), F.lit("")) != ""
    j = requests.join(by_id, requests.order_id == by_id["_oid"], "left").join(first, "session_id", "left")
    return j.select("request_id", F.when(given, F.col("_oid")).otherwise(F.col("f.order_id")).alias("order_id"),
                    F.when(given, F.col("p1")).otherwise(F.col("f.phrase")).alias("status"),
                    F.when(given & F.col("_oid").isNull(), F.lit("ORDER_NOT_FOUND"))
                    .when(~given & F.col("f").isNull(), F.lit("NO_ORDER_IN_SESSION")).alias("error_code"))


def stock_status(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """request_id, sku, size, available, note, error_code; a blank size lists all sizes of the product.

    ``requests``: request_id, sku, size; ``stock``: sku, size, available, restock_date. Both cases are one equi-join each.
    """
    note = F.when(F.col("available") > 0, F.lit("有货")).otherwise(F.concat(F.lit("缺货，预计 "), F.coalesce(F.col("restock_date").cast("string"), F.lit("?")), F.lit(" 补货")))
    s = stock.select("sku", F.col("size").alias("stock_size"), "available", note.alias("note"))
    sized = requests.withColumn("size", F.upper(F.coalesce("size", F.lit(""))))
    one = sized.filter("size <> ''").join(s, (sized.sku == s.sku) & (F.col("size") == F.col("stock_size")), "left").select(
        "request_id", sized.sku, "size", "available", "note", F.when(F.col("stock_size").isNull(), F.lit("SIZE_NOT_FOUND")).alias("error_code"))
    every = sized.filter("size = ''").drop("size").join(s, "sku", "left").select(
        "request_id", "sku", F.col("stock_size").alias("size"), "available", "note", F.when(F.col("stock_size").isNull(), F.lit("SKU_NOT_FOUND")).alias("error_code"))
    return one.unionByName(every)


def return_eligibility(orders: DataFrame, as_of: Column, window_days: int = lx.RETURN_WINDOW_DAYS, reason: Column | None = None) -> DataFrame:
    """order_id, eligible, days, remaining_days, why, can_file. A quality reason may be filed after the window."""
    days = F.datediff(as_of, F.col("delivered_at"))
    there = (F.col("status") == "delivered") & F.col("delivered_at").isNotNull()
    ok = there & (days <= window_days)
    quality = F.coalesce(reason.contains("质量"), F.lit(False)) if reason is not None else F.lit(False)
    return orders.select("order_id", ok.alias("eligible"), F.when(there, days).alias("days"), F.when(ok, F.lit(window_days) - days).alias("remaining_days"),
                         F.when(ok, F.lit("in_window")).when(there, F.lit("too_late")).otherwise(F.concat(F.lit("not_delivered:"), F.col("status"))).alias("why"),
                         (ok | quality).alias("can_file"))


def link_orders(orders: DataFrame, sessions: DataFrame, key: str = "customer") -> DataFrame:
    """Attach every order to the customer's latest session that started at or before it.

    As-of join without pairing rows: both sides are merged in time order per (customer, day), the last session seen is carried
    inside the day, and the day before's last session is carried over from a table with one row per customer and day.
    ``orders``: order_id, customer, ts; ``sessions``: session_id, customer, ts.
    """
    a = sessions.select(key, "ts", F.struct("ts", "session_id").alias("s"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("order_id"))
    b = orders.select(key, "ts", F.lit(None).cast(a.schema["s"].dataType).alias("s"), F.lit(1).alias("side"), F.col("order_id").cast("long"))
    both = a.unionByName(b).withColumn("day", F.to_date("ts"))
    # at equal times sessions come first, the highest session id last
    w = Window.partitionBy(key, "day").orderBy("ts", "side", F.coalesce(F.col("s.session_id").cast("long"), F.lit(0)), F.coalesce("order_id", F.lit(0))).rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("in_day", F.last("s", ignorenulls=True).over(w)).filter("side = 1")
    last = both.groupBy(key, "day").agg(F.max("s").alias("s"))
    wl = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("before", F.last("s", ignorenulls=True).over(wl)).select(key, "day", "before")
    return local.join(carried, [key, "day"]).select("order_id", key, F.coalesce(F.col("in_day.session_id"), F.col("before.session_id")).alias("session_id"))


# ---- service and training logs ----

def load_summary(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, n_ok, n_fail, wall_s, qps, latency percentiles and mean over successful requests. ``log``: ts, ms, ok."""
    wall = F.max(_seconds("ts")) - F.min(_seconds("ts"))
    base = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_done"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_fail"),
                                  wall.alias("wall_s"), F.avg(F.when(F.col("ok"), F.col("ms"))).alias("mean"))
    base = base.withColumn("qps", F.col("n_done") / F.nullif("wall_s", F.lit(0.0)))
    q = exact_quantiles(log.filter("ok"), keys, "ms", {"p50": (0.5, "linear"), "p95": (0.95, "linear"), "p99": (0.99, "linear")})
    return base.join(q, list(keys), "left")


def load_errors(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.filter(~F.col("ok")).groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))


def best_concurrency(summary: DataFrame, key: str) -> DataFrame:
    return summary.agg(F.max_by(key, "qps").alias("best"), F.max("qps").alias("qps"))


def generation_latency(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First-token percentiles by index and tokens per second. ``log``: ttft_ms, tokens, ts."""
    wall = F.max(_seconds("ts")) - F.min(_seconds("ts"))
    base = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ok"), (F.sum("tokens") / F.nullif(wall, F.lit(0.0))).alias("tokens_per_s"))
    return base.join(exact_quantiles(log, keys, "ttft_ms", {"ttft_p50": (0.5, "index"), "ttft_p95": (0.95, "index")}), list(keys))


def train_diagnostics(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, code) rows. ``log``: run, step, loss, eval_loss, grad_norm. Head and tail are cut by rank filters; only the later
    half of the gradients needs positions, which come from chunked numbering."""
    lo = log.filter("loss is not null")
    n = lo.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    head = top_per_group(lo, [run], [F.col("step")], 5, "_r").groupBy(run).agg(F.avg("loss").alias("head"))
    tail = top_per_group(lo, [run], [F.col("step").desc()], 10, "_r").groupBy(run).agg(
        F.avg(F.when(F.col("_r") <= 5, F.col("loss"))).alias("tail"), F.stddev_samp("loss").alias("sd10"), F.avg("loss").alias("mean10"))
    ev = top_per_group(log.filter("eval_loss is not null"), [run], [F.col("step").desc()], 2, "_r").groupBy(run).agg(
        F.max(F.when(F.col("_r") == 1, F.col("eval_loss"))).alias("ev1"), F.max(F.when(F.col("_r") == 2, F.col("eval_loss"))).alias("ev2"))
    gr = log.filter("grad_norm is not null")
    pos = rank_in_groups(gr.select(run, "step", "grad_norm"), [run], [F.col("step")], F.floor(F.col("step") / 10_000), "_p")
    tot = gr.groupBy(F.col(run).alias("_run")).agg(F.count(F.lit(1)).alias("gn"), F.avg("grad_norm").alias("g_avg"), F.max("grad_norm").alias("g_max"))
    late = pos.join(tot, pos[run] == tot["_run"]).groupBy(run, "g_avg", "g_max").agg(
        F.avg(F.when(F.col("_p") > F.floor(F.col("gn") / 2), F.col("grad_norm"))).alias("g_late"))
    j = log.select(run).distinct().join(n, run, "left").join(head, run, "left").join(tail, run, "left").join(ev, run, "left").join(late, run, "left")
    drop = F.when(F.col("head") != 0, (F.col("head") - F.col("tail")) / F.col("head")).otherwise(F.lit(0.0))
    codes = F.array_compact(F.array(
        F.when(F.col("n").isNull(), F.lit("no_loss")),
        F.when(F.col("n") >= 10, F.when(drop < 0.03, F.lit("loss_flat")).when(drop > 0.7, F.lit("loss_too_fast")).otherwise(F.lit("loss_ok"))),
        F.when((F.col("n") >= 20) & (F.col("sd10") > 0.15 * F.col("mean10")), F.lit("tail_noisy")),
        F.when(F.col("n").isNotNull() & F.col("ev2").isNotNull(), F.when(F.col("ev1") > F.col("ev2") * 1.02, F.lit("eval_rising")).otherwise(F.lit("eval_ok"))),
        F.when(F.col("n").isNotNull() & F.col("g_max").isNotNull(), F.when(F.col("g_max") > 10, F.lit("grad_explodes"))
               .when(F.col("g_late") > F.col("g_avg") * 1.5, F.lit("grad_rises_late")).otherwise(F.lit("grad_ok")))))
    return j.select(run, F.explode(codes).alias("code"))


def unit_economics(qps: DataFrame, grid: DataFrame) -> DataFrame:
    """Margins over a parameter grid. ``qps``: one row; ``grid``: label, gpu_hourly, peak, price, quota, cut, infra_monthly."""
    q = qps.select("qps").scalar()
    per_hour = q / F.col("peak") * 3600
    gpu = F.col("gpu_hourly") / per_hour
    gross = F.col("price") * (1 - F.col("cut"))
    margin = (gross - gpu * F.col("quota")) / gross
    shops = F.floor(F.col("infra_monthly") / F.greatest(F.col("price") * margin, F.lit(1.0))) + 1
    return grid.select("label", gpu.alias("gpu_per_session"), (F.col("price") / F.col("quota")).alias("revenue_per_session"),
                       margin.alias("margin"), shops.cast("long").alias("breakeven_shops"))


def shop_unit_economics(gpu_per_hour: float = 8.0, sessions_per_hour: float = 800.0, infra_monthly: float = 300.0, plan: str = "standard") -> dict:
    """The same calculation for one list-price plan."""
    price, included, _ = lx.PLANS[plan]
    cost, revenue = gpu_per_hour / sessions_per_hour, price / included
    margin = (revenue - cost) / revenue
    return {"gpu_cost_per_session": cost, "revenue_per_session": revenue, "margin": margin, "breakeven_shops": int(infra_monthly / max(price * margin, 1)) + 1}
