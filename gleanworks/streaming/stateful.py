"""Live counterparts of the guard replay and the usage ledger: per-key state with timers, one small Python step per event.

Rows wait in a list state until the watermark has passed them and are then taken in time order, so rows that come late, or over several micro-batches out of order, are judged where they
belong, as long as they are no later than the watermark's delay; Spark leaves out those that are. Besides the waiting rows only running totals, seen keys and the last few action keys are kept per key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import lexicons as lx

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


CHUNK = 1_000  # rows in one element of a list state


def _packed(rows: list) -> list[tuple[str]]:
    """Elements of a list state that hold ``rows``: Spark converts and writes every element by itself, which costs far more than the few numbers of a row."""
    return [(json.dumps(rows[i:i + CHUNK]),) for i in range(0, len(rows), CHUNK)]


def _unpacked(state) -> list:
    return [r for e in state.get() for r in json.loads(e[0])] if state.exists() else []


class InOrder(StatefulProcessor):
    """Buffers rows (``columns`` of the input, with ts and seq) and hands them to ``take`` in the order of (ts, seq) once the watermark has passed them.

    ``idle_ms`` after a key's last row its state is dropped; None keeps it.
    """

    columns: T.StructType
    output: T.StructType
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _schema(("rows", T.StringType())))
        self.last = handle.getValueState("last", _schema(("ms", T.LongType())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            if not len(f):
                continue
            us = f["ts"].to_numpy("datetime64[us]").astype("int64")
            values = [[None if v is None else self.plain(c, v) for v in f[c].tolist()] for c in self.columns.names]
            self.waiting.appendList(_packed(list(zip(us.tolist(), *values))))
            first = min(us) if first is None else min(first, us.min())
        if first is not None:
            self.handle.registerTimer(int(first // 1000))
        yield from ()  # a frame without rows would be converted for every key

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = _unpacked(self.waiting)
        due = sorted((r for r in held if r[0] // 1000 <= passed), key=lambda r: (r[0], r[1]))
        rest = [r for r in held if r[0] // 1000 > passed]
        out: list[tuple] = []
        if due:
            self.waiting.put(_packed(rest)) if rest else self.waiting.clear()
            out = self.take(key, [dict(zip(("us", *self.columns.names), r)) for r in due])
            if self.idle_ms is not None:
                self.last.update((due[-1][0] // 1000,))
        if rest:
            self.handle.registerTimer(int(min(r[0] for r in rest) // 1000))
        elif self.idle_ms is not None and self.last.exists():
            over = int(self.last.get()[0]) + self.idle_ms
            if over <= passed:
                self.forget()
                self.last.clear()
            else:
                self.handle.registerTimer(over)
        if out:
            yield pd.DataFrame(out, columns=self.output.names)

    def plain(self, column: str, value):
        """A value as the buffer keeps it."""
        kind = self.columns[column].dataType
        return str(value) if isinstance(kind, T.StringType) else bool(value) if isinstance(kind, T.BooleanType) else float(value) if isinstance(kind, T.DoubleType) else int(value)

    def take(self, key, rows: list[dict]) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


GUARD_OUT = _schema(("session_id", T.LongType()), ("turn", T.LongType()), ("seq", T.LongType()), ("gate", T.StringType()))


class GuardMonitor(InOrder):
    """Emits the first gate a session trips, once; sessions idle for ``idle_ms`` are forgotten."""

    columns = _schema(("seq", T.LongType()), ("turn", T.LongType()), ("is_tool", T.BooleanType()), ("cost", T.DoubleType()), ("tokens", T.LongType()), ("action_key", T.StringType()))
    output = GUARD_OUT

    def __init__(self, limits: dict, idle_ms: int | None, window: int = 6):
        self.limits, self.idle_ms, self.window = dict(limits), idle_ms, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("totals", _schema(
            ("turn", T.LongType()), ("steps", T.LongType()), ("tools", T.LongType()), ("start", T.DoubleType()), ("cost", T.DoubleType()),
            ("tokens", T.LongType()), ("turns", T.LongType()), ("tripped", T.BooleanType())))
        self.recent = handle.getListState("recent", _schema(("key", T.StringType())))

    def _gate(self, s: dict, row: dict, recent: list[str]) -> str | None:
        lim = self.limits
        checks = (("steps", s["steps"], lim["steps"]), ("tools", s["tools"], lim["tools"]), ("wall_clock", row["us"] / 1e6 - s["start"], lim["wall_s"]),
                  ("cost", s["cost"], lim["cost"]), ("tokens", s["tokens"], lim["tokens"]), ("turns", s["turns"], lim["turns"]))
        for name, value, limit in checks:
            if value > limit:
                return name
        if row["is_tool"] and recent.count(row["action_key"]) >= lim["repeat"] - 1:
            return "repeat"
        return None

    def take(self, key, rows: list[dict]) -> list[tuple]:
        names = ("turn", "steps", "tools", "start", "cost", "tokens", "turns", "tripped")
        s = dict(zip(names, self.state.get())) if self.state.exists() else dict(zip(names, (None, 0, 0, 0.0, 0.0, 0, 0, False)))
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        out = []
        for row in rows:
            if s["turn"] != row["turn"]:
                s.update(turn=row["turn"], steps=0, tools=0, start=row["us"] / 1e6, turns=s["turns"] + 1)
            s["steps"] += 1
            gate = self._gate(s, row, recent)
            if gate and not s["tripped"]:
                s["tripped"] = True
                out.append((int(key[0]), row["turn"], row["seq"], gate))
            s["cost"] += row["cost"]
            s["tokens"] += row["tokens"]
            if row["is_tool"]:
                s["tools"] += 1
                recent = (recent + [row["action_key"]])[-self.window:]
        self.state.update(tuple(s[n] for n in names))
        self.recent.put([(k,) for k in recent]) if recent else self.recent.clear()
        return out

    def forget(self) -> None:
        self.state.clear()
        self.recent.clear()


def guardrail_monitor(steps: DataFrame, limits: dict = lx.GUARD_LIMITS, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``steps``: session_id long, turn, ts, seq, is_tool, cost, tokens, action_key."""
    return steps.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=GuardMonitor(limits, idle_ms), outputStructType=GUARD_OUT, outputMode="Append", timeMode="EventTime")


USAGE_OUT = _schema(("seq", T.LongType()), ("shop", T.StringType()), ("key", T.StringType()), ("outcome", T.StringType()), ("charged", T.DecimalType(12, 4)))


class UsageMeter(InOrder):
    """Quota, cap and seen keys of one shop and period; dropped ``idle_ms`` after the period's last event if that is given."""

    columns = _schema(("seq", T.LongType()), ("key", T.StringType()), ("amount", T.StringType()), ("included", T.LongType()), ("subscription_id", T.StringType()), ("cap", T.StringType()))
    output = USAGE_OUT

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("account", _schema(("sessions", T.LongType()), ("usage", T.StringType())))
        self.keys = handle.getListState("keys", _schema(("keys", T.StringType())))

    def take(self, key, rows: list[dict]) -> list[tuple]:
        # every call to the state is a trip to the JVM: the seen keys come and go as lists, not one trip for each row
        sessions, usage, seen, new = 0, Decimal(0), set(), []
        if self.state.exists():
            got = self.state.get()
            sessions, usage = int(got[0]), Decimal(got[1])
            seen = set(_unpacked(self.keys))
        out = []
        for row in rows:
            amount, cap, charged = Decimal(row["amount"]), Decimal(row["cap"]), Decimal(0)
            if row["key"] in seen:
                outcome = "duplicate"
            elif cap and usage + amount > cap:
                outcome = "capped"
            elif sessions < row["included"]:
                outcome, sessions = "included", sessions + 1
            elif not row["subscription_id"]:
                outcome = "no_subscription"
            else:
                outcome, charged, sessions, usage = "charged", amount, sessions + 1, usage + amount
            if outcome in ("included", "charged"):
                seen.add(row["key"])
                new.append(row["key"])
            out.append((row["seq"], str(key[0]), row["key"], outcome, charged))
        self.state.update((sessions, str(usage)))
        if new:
            self.keys.appendList(_packed(new))
        return out

    def forget(self) -> None:
        self.state.clear()
        self.keys.clear()


def usage_meter(events: DataFrame, late: str = "10 minutes", idle_ms: int | None = 40 * 86_400_000) -> DataFrame:
    """``events``: seq, key, shop, period, amount decimal, ts, included, subscription_id, cap (plan columns joined before)."""
    return events.withWatermark("ts", late).groupBy("shop", "period").transformWithStateInPandas(
        statefulProcessor=UsageMeter(idle_ms), outputStructType=USAGE_OUT, outputMode="Append", timeMode="EventTime")
