"""Streams that take rows in event-time order: shuffled micro-batches give the batch result."""
import os
import random
import time
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from gleanworks.streaming import stateful as stf

BASE = 1_700_000_000


def in_three_batches(spark, rows, schema, folder):
    """A stream of three shuffled files, one a micro-batch, then a row of no key that moves the watermark past all of them."""
    random.Random(7).shuffle(rows)
    last = max(r[-1] for r in rows)
    closing = [(*(None if not isinstance(v, str) else "" for v in rows[0][:-1]), last + 40 * 86_400)]
    os.makedirs(folder)
    for k, part in enumerate([rows[0::3], rows[1::3], rows[2::3], closing]):
        names = [c.split()[0] for c in schema.split(", ")]
        pd.DataFrame(part, columns=names).to_json(f"{folder}/{k}.json", orient="records", lines=True)
        at = time.time() - 1000 + 10 * k
        os.utime(f"{folder}/{k}.json", (at, at))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    return s.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def run(stream, folder):
    stream.sparkSession.conf.set(*stf.ROCKSDB)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) >= 4
    return stream.sparkSession.read.parquet(f"{folder}/out").collect()


def test_usage_is_charged_in_order_over_shuffled_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randint(0, 150)}", f"s{i % 4}", "2023-11", rng.randint(1, 40), 3, "sub" if i % 4 else "", 12.0 * (i % 4), BASE + rng.randint(0, 3600)) for i in range(240)]
    rows = [(*r[:4], hash(r[1]) % 40 + 1, *r[5:]) for r in rows]
    schema = "seq long, key string, shop string, period string, amount long, included long, subscription_id string, cap double, t long"
    want, state = {}, {}
    for seq, key, shop, period, amount, included, sub, cap, t in sorted(rows, key=lambda r: (r[-1], r[0])):
        s = state.setdefault(shop, {"n": 0, "used": Decimal(0), "keys": set()})
        amount, cap = Decimal(amount), Decimal(str(cap))
        out, charged = "charged", Decimal(0)
        if key in s["keys"]:
            out = "duplicate"
        elif cap and s["used"] + amount > cap:
            out = "capped"
        elif s["n"] < included:
            out = "included"
        elif not sub:
            out = "no_subscription"
        else:
            charged = amount
            s["used"] += amount
        if out in ("included", "charged"):
            s["n"] += 1
            s["keys"].add(key)
        want[seq] = (out, charged)
    stream = in_three_batches(spark, list(rows), schema, str(tmp_path / "in")).withColumns({"amount": F.col("amount").cast("decimal(10,4)"), "cap": F.col("cap").cast("decimal(10,4)")})
    stream = stream.fillna({"amount": 0, "included": 0, "cap": 0, "seq": -1})
    got = {r.seq: (r.outcome, r.charged) for r in run(stf.usage_meter(stream, late="2 hours", idle_ms=None), str(tmp_path)) if r.seq >= 0}
    assert got == want


def test_usage_meter_asks_the_state_a_fixed_number_of_times():
    """Calls to the state are trips to the JVM: their number must not grow with the rows of a shop."""
    class State:
        def __init__(self):
            self.held, self.calls = [], 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name in ("update", "appendList", "put"):
                    self.held = [*self.held, *args[0]] if name == "appendList" else args[0]
                return {"exists": bool(self.held), "get": self.held}.get(name)

            return call

    class Handle:
        def __init__(self):
            self.states = []

        def make(self, *_):
            self.states.append(State())
            return self.states[-1]

        getListState = getValueState = getMapState = make

    def row(i, key):
        return dict(us=i, seq=i, key=key, amount="1", included=40, subscription_id="", cap="0")

    handle, meter = Handle(), stf.UsageMeter(None)
    meter.init(handle)
    first = meter.take(("s", "p"), [row(i, f"k{i // 2}") for i in range(100)])
    again = meter.take(("s", "p"), [row(100 + i, f"k{i}") for i in range(50)])
    assert [r[3] for r in first] == (["included", "duplicate"] * 40 + ["no_subscription"] * 20)
    assert [r[3] for r in again] == ["duplicate"] * 40 + ["no_subscription"] * 10
    assert sum(s.calls for s in handle.states) <= 12 and len(handle.states[-1].held) <= 2


def test_guard_trips_at_the_same_step_over_shuffled_batches(spark, tmp_path):
    rng = random.Random(2)
    limits = {"steps": 6, "tools": 3, "wall_s": 900, "cost": 2.0, "tokens": 900, "turns": 4, "repeat": 3}
    rows = [(i, i % 5, rng.randint(0, 3), bool(rng.randint(0, 1)), rng.choice([0.01, 0.2]), rng.randint(1, 60), f"a{rng.randint(0, 3)}", BASE + 7 * i) for i in range(200)]
    rows = [(*r[:2], (r[-1] - BASE) // 300, *r[3:]) for r in rows]
    schema = "seq long, session_id long, turn long, is_tool boolean, cost double, tokens long, action_key string, t long"
    want, state = {}, {}
    for seq, session, turn, is_tool, cost, tokens, action, t in sorted(rows, key=lambda r: (r[-1], r[0])):
        s = state.setdefault(session, dict(turn=None, steps=0, tools=0, start=0, cost=0.0, tokens=0, turns=0, recent=[]))
        if s["turn"] != turn:
            s.update(turn=turn, steps=0, tools=0, start=t, turns=s["turns"] + 1)
        s["steps"] += 1
        values = {"steps": s["steps"], "tools": s["tools"], "wall_s": t - s["start"], "cost": s["cost"], "tokens": s["tokens"], "turns": s["turns"]}
        gate = next((k for k, v in values.items() if v > limits[k]), None)
        if not gate and is_tool and s["recent"].count(action) >= limits["repeat"] - 1:
            gate = "repeat"
        if gate and session not in want:
            want[session] = (seq, "wall_clock" if gate == "wall_s" else gate)
        s["cost"] += cost
        s["tokens"] += tokens
        if is_tool:
            s["tools"] += 1
            s["recent"] = (s["recent"] + [action])[-6:]
    stream = in_three_batches(spark, list(rows), schema, str(tmp_path / "in")).fillna({"seq": -1, "session_id": -1, "turn": 0, "cost": 0.0, "tokens": 0}).fillna({"is_tool": False})
    got = {r.session_id: (r.seq, r.gate) for r in run(stf.guardrail_monitor(stream, limits, late="2 hours", idle_ms=None), str(tmp_path)) if r.session_id >= 0}
    assert got == want and len(want) == 5
