"""Usage metering: idempotent ledger with quota and cap, entitlement, reconciliation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicons as lx
from ..ordering import first_wins, rank_in_groups, running_sums, time_cuts
from ..session import cut_lineage

PARALLEL_ROUNDS = 2


def usage_minute_key(shop: Column, amount: Column, description: Column, ts: Column) -> Column:
    """Default key of a report without one: the same charge within one minute counts once."""
    minute = F.floor(F.unix_timestamp(ts) / 60).cast("string")
    return F.md5(F.concat_ws("|", shop, amount.cast("string"), description, minute).cast("binary"))


def _plan_value(plan: Column, i: int, plans: Mapping[str, tuple]) -> Column:
    m = F.create_map(*[x for p, v in plans.items() for x in (F.lit(p), F.lit(v[i]))])
    return F.coalesce(F.try_element_at(m, plan), F.lit(plans["free"][i]))


def _fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each amount fits what is left of its shop's cap; rows come shop by shop in order, the balance goes on from batch to batch."""
    at, left = None, 0
    for b in frames:
        fits = []
        for shop, period, amount, cap in zip(*[b.column(c).to_pylist() for c in ("shop", "period", "amount", "left")]):
            if (shop, period) != at:
                at, left = (shop, period), cap
            fits.append(amount <= left)
            if fits[-1]:
                left -= amount
        keep = ["seq", "key", "shop", "period", "amount"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(fits, pa.bool_())], [*keep, "fits"])


def usage_ledger(events: DataFrame, subs: DataFrame, plans: Mapping[str, tuple] = lx.PLANS) -> DataFrame:
    """(seq, key, shop, period, outcome, charged) for every reported event.

    ``events``: seq, key, shop, period, amount (decimal), ts; ``subs``: shop, plan, subscription_id, capped_amount (decimal).
    A key stands for one charge, so repeated reports of a key carry the same amount.
    Order of decisions per shop and period: duplicate key, cap, quota, subscription. A rejected charge does not use up cap, so
    the outcome depends on order. ``PARALLEL_ROUNDS`` rounds of chunked running sums settle all shops together up to their next crossing of the cap; after a crossing every
    later amount above the remaining cap is rejected at once (the rest of the cap only shrinks), which ends equal-price shops. What is left, later amounts that
    still fit, is sorted by shop, period and time and streamed through ``_fold``: one pass for any number of crossings, holding one balance at a time.
    """
    order = [F.col("ts"), F.col("seq")]
    part = F.col("_cut")
    firsts = first_wins(events.withColumn("_o", F.struct("ts", "seq")), ["shop", "period", "key"], "_o").drop("_o")
    firsts = cut_lineage(time_cuts(firsts, ["shop", "period"], "ts"))
    cap = F.coalesce(F.col("capped_amount"), F.lit(0).cast("decimal(10,4)"))
    j = firsts.join(subs.select("shop", "plan", "subscription_id", "capped_amount"), "shop", "left")
    j = j.withColumn("cap", cap).withColumn("included", _plan_value(F.col("plan"), 1, plans))
    j = j.withColumn("too_big", (F.col("cap") > 0) & (F.col("amount") > F.col("cap")))
    fits = rank_in_groups(j.filter(~F.col("too_big")), ["shop", "period"], order, part, "r")
    fits = cut_lineage(fits)
    cols = ["seq", "key", "shop", "period", "outcome", "charged"]
    zero = F.lit(0).cast("decimal(12,4)")
    has_sub = F.coalesce(F.col("subscription_id"), F.lit("")) != ""
    done = [
        j.filter("too_big").withColumn("outcome", F.lit("capped")).withColumn("charged", zero).select(*cols),
        fits.filter("r <= included").withColumn("outcome", F.lit("included")).withColumn("charged", zero).select(*cols),
        fits.filter((F.col("r") > F.col("included")) & ~has_sub).withColumn("outcome", F.lit("no_subscription")).withColumn("charged", zero).select(*cols),
    ]
    rest = fits.filter((F.col("r") > F.col("included")) & has_sub).select("seq", "key", "shop", "period", "ts", "amount", "cap", "_cut")
    done.append(rest.filter("cap = 0").select("seq", "key", "shop", "period", F.lit("charged").alias("outcome"), F.col("amount").cast("decimal(12,4)").alias("charged")))
    todo = cut_lineage(rest.filter("cap > 0"))
    for _ in range(PARALLEL_ROUNDS):  # every round settles at least one event of every open shop; "cap" is what is left of it
        if todo.isEmpty():
            break
        run = cut_lineage(running_sums(todo, ["shop", "period"], order, part, {"total": F.col("amount")}))
        cross = run.filter("total > cap").groupBy("shop", "period").agg(F.min(F.struct("ts", "seq")).alias("x"))
        seen = run.join(cross, ["shop", "period"], "left")
        at = F.struct("ts", "seq")
        before = F.col("x").isNull() | (at < F.col("x"))
        ok = seen.filter(before)
        done.append(ok.select("seq", "key", "shop", "period", F.lit("charged").alias("outcome"), F.col("amount").cast("decimal(12,4)").alias("charged")))
        used = ok.groupBy("shop", "period").agg(F.sum("amount").alias("used"))
        later = seen.filter(~before).join(used, ["shop", "period"], "left").withColumn("left", (F.col("cap") - F.coalesce("used", F.lit(0))).cast("decimal(12,4)"))
        out = (at == F.col("x")) | (F.col("amount") > F.col("left"))
        done.append(later.filter(out).select("seq", "key", "shop", "period", F.lit("capped").alias("outcome"), zero.alias("charged")))
        todo = cut_lineage(later.filter(~out).select("seq", "key", "shop", "period", "ts", "amount", F.col("left").alias("cap"), "_cut"))
    if not todo.isEmpty():
        cents = todo.select("seq", "key", "shop", "period", "ts", (F.col("amount") * 10_000).cast("long").alias("amount"), (F.col("cap") * 10_000).cast("long").alias("left"))
        sorted_rows = cents.repartition("shop", "period").sortWithinPartitions("shop", "period", "ts", "seq").drop("ts")
        period = events.schema["period"].dataType.simpleString()
        fits_at = sorted_rows.mapInArrow(_fold, f"seq long, key string, shop string, period {period}, amount long, fits boolean")
        done.append(fits_at.select("seq", "key", "shop", "period", F.when(F.col("fits"), "charged").otherwise("capped").alias("outcome"),
                                   F.when(F.col("fits"), (F.col("amount") / F.lit(10_000).cast("decimal(10,0)")).cast("decimal(12,4)")).otherwise(zero).alias("charged")))
    settled = cut_lineage(reduce(DataFrame.unionByName, done))
    # repeats: of an accepted key they are duplicates, of a rejected key they meet the same rejection
    first = settled.select("shop", "period", "key", F.col("seq").alias("first_seq"), "outcome", "charged")
    accepted = F.col("outcome").isin("included", "charged")
    own = F.col("seq") == F.col("first_seq")
    return events.select("seq", "shop", "period", "key").join(first, ["shop", "period", "key"]).select(
        "seq", "key", "shop", "period", F.when(own | ~accepted, F.col("outcome")).otherwise(F.lit("duplicate")).alias("outcome"),
        F.when(own, F.col("charged")).otherwise(zero).alias("charged"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """shop, period, sessions, usage: what the subscription state holds at the end."""
    took = F.col("outcome").isin("included", "charged")
    return ledger.groupBy("shop", "period").agg(F.count(F.when(took, 1)).alias("sessions"), F.sum("charged").alias("usage"))


def entitlement(shops: DataFrame, subs: DataFrame, totals: DataFrame, plans: Mapping[str, tuple] = lx.PLANS) -> DataFrame:
    """shop, plan, allowed, reason. ``totals``: shop, sessions, usage of the current period."""
    j = shops.join(subs.select("shop", "plan", "status", "capped_amount"), "shop", "left").join(totals.select("shop", "sessions", "usage"), "shop", "left")
    plan = F.coalesce("plan", F.lit("free"))
    included, over = _plan_value(plan, 1, plans), _plan_value(plan, 2, plans)
    used, cap = F.coalesce("sessions", F.lit(0)), F.coalesce("capped_amount", F.lit(0))
    reason = (F.when(F.coalesce("status", F.lit("active")).isin("cancelled", "expired", "frozen"), F.concat(F.lit("status:"), F.col("status")))
              .when((included > 0) & (used >= included) & (over <= 0), F.lit("quota_used"))
              .when((cap > 0) & (F.coalesce("usage", F.lit(0)) >= cap), F.lit("cap_reached")))
    return j.select("shop", plan.alias("plan"), reason.isNull().alias("allowed"), reason.alias("reason"))


def ledger_reconcile(local: DataFrame, reported: DataFrame) -> DataFrame:
    """Keys on one side only and amounts that differ. Both: key, amount."""
    a = local.select("key", F.col("amount").alias("local_amount"), F.lit(1).alias("_l"))
    b = reported.select("key", F.col("amount").alias("reported_amount"), F.lit(1).alias("_r"))
    state = (F.when(F.col("_r").isNull(), F.lit("not_reported")).when(F.col("_l").isNull(), F.lit("not_local"))
             .when(~F.col("local_amount").eqNullSafe(F.col("reported_amount")), F.lit("amount_differs")))
    return a.join(b, "key", "full").withColumn("problem", state).filter("problem is not null").select("key", "local_amount", "reported_amount", "problem")


def latest_products(changes: DataFrame) -> DataFrame:
    """Newest version per shop and product; deletes applied. ``changes``: shop, id, updated_at, seq, deleted, ..."""
    c = changes.withColumn("_o", F.struct(-F.unix_micros("updated_at"), -F.col("seq")))
    return first_wins(c, ["shop", "id"], "_o").filter(~F.col("deleted")).drop("_o")
