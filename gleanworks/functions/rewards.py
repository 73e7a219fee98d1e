"""Verifiable rewards over a completion, as columns. ``parsed`` is what ``jsonx.extract_json`` found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .. import lexicons as lx
from . import jsonx, text as tx


def reward_format(parsed: Column, required: Sequence[str] = ("action",)) -> Column:
    """1 for an object with all required keys, 0.3 when only some are there, 0 without action, response or answer."""
    ks = jsonx.keys(parsed)
    has = lambda k: F.array_contains(ks, k)
    missing = F.lit(False)
    for k in required:
        if k != "action":
            missing = missing | ~has(k)
    return (F.when(~jsonx.is_object(parsed) | ~(has("action") | has("response") | has("answer")), 0.0)
            .when(missing, 0.3).otherwise(1.0))


def called_tool(parsed: Column) -> Column:
    return F.get_json_object(parsed, "$.action")


def reward_tool_call(parsed: Column, expected: Column, allowed: Column | None = None) -> Column:
    """No expected tool means that answering directly is right; a tool outside ``allowed`` never scores."""
    called = called_tool(parsed)
    direct = called.isNull() | called.isin("", "final_answer", "respond")
    unknown = F.lit(False)
    if allowed is not None:
        unknown = F.coalesce((F.size(allowed) > 0) & called.isNotNull() & ~F.array_contains(allowed, called), F.lit(False))
    right = F.coalesce(called == expected, F.lit(False))
    return (F.when(parsed.isNull(), 0.0).when(expected.isNull(), F.when(direct, 1.0).otherwise(0.0))
            .when(unknown, 0.0).when(right, 1.0).otherwise(0.0))


def call_arguments(parsed: Column) -> Column:
    """action_input, or arguments when that is absent or empty, as a string map; NULL when it is not an object."""
    empty = lambda c: c.isNull() | c.isin("", "{}", "[]", "null", "0", "false")
    first, second = F.get_json_object(parsed, "$.action_input"), F.get_json_object(parsed, "$.arguments")
    raw = F.when(~empty(first), first).when(~empty(second), second).otherwise(F.lit("{}"))
    return F.when(raw.startswith("{"), F.from_json(raw, "map<string,string>"))


def reward_slot_filling(parsed: Column, expected: Column) -> Column:
    args = call_arguments(parsed)
    want = F.map_entries(F.coalesce(expected, F.create_map().cast("map<string,string>")))
    same = F.filter(want, lambda e: F.coalesce(tx.strip(F.try_element_at(args, e["key"])) == tx.strip(e["value"]), F.lit(False)))
    return F.when(parsed.isNull() | args.isNull(), 0.0).when(F.size(want) == 0, 1.0).otherwise(F.size(same) / F.greatest(F.size(want), F.lit(1)))


def visual_claims(text: Column, visible: Column, words: Sequence[str] = lx.VISUAL_WORDS) -> Column:
    """struct<grounded, phantom>: visible objects are consumed longest first, then lexicon words longest first.

    A fold over a word array that carries the remaining text, so "浅蓝色" is taken before "蓝色" can match inside it.
    """
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(visible, F.array().cast("array<string>")), tx.strip), lambda o: F.length(o) > 0))
    by_len = F.array_sort(clean, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    none = F.array().cast("array<string>")
    start = F.struct(text.alias("rest"), none.alias("grounded"), none.alias("phantom"))

    def take(acc: Column, word: Column, grounded: Column) -> Column:
        found = F.contains(acc["rest"], word)
        one = F.array(word)
        return F.struct(F.when(found, F.replace(acc["rest"], word, F.lit("\x00"))).otherwise(acc["rest"]).alias("rest"),
                        F.when(found & grounded, F.array_union(acc["grounded"], one)).otherwise(acc["grounded"]).alias("grounded"),
                        F.when(found & ~grounded, F.array_union(acc["phantom"], one)).otherwise(acc["phantom"]).alias("phantom"))

    seen = F.aggregate(by_len, start, lambda acc, o: take(acc, o, F.lit(True)))
    lexicon = tx.lit_array(sorted(words, key=len, reverse=True))
    related = lambda w: F.exists(clean, lambda o: F.contains(o, w) | F.contains(w, o))
    done = F.aggregate(lexicon, seen, lambda acc, w: take(acc, w, related(w)))
    return F.struct(done["grounded"].alias("grounded"), done["phantom"].alias("phantom"))


def reward_grounding(claims: Column) -> Column:
    n = F.size(claims["grounded"]) + F.size(claims["phantom"])
    return F.when(n == 0, 0.5).otherwise(F.size(claims["grounded"]) / F.greatest(n, F.lit(1)))


def phantom_penalty(claims: Column, penalty: float = 1.0) -> Column:
    return F.when(F.size(claims["phantom"]) == 0, 0.0).otherwise(F.size(claims["phantom"]) * F.lit(-penalty))


def reward_refusal(text: Column, should_refuse: Column, markers: Sequence[str] = lx.REWARD_REFUSALS) -> Column:
    said = tx.contains_any(text, markers)
    return F.when(should_refuse, F.when(said, 1.0).otherwise(0.0)).otherwise(F.when(said, -0.5).otherwise(1.0))


def length_overrun(text: Column, target: int | Column = 150) -> Column:
    target = F.lit(target) if isinstance(target, int) else target
    return F.greatest(F.lit(0), F.length(text) - target * 2) / 100


def compute_reward(text: Column, parsed: Column, claims: Column, expected_tool: Column, expected_slots: Column, allowed: Column | None,
                   should_refuse: Column, target_length: int | Column = 150, weights: Mapping[str, float] = lx.REWARD_WEIGHTS) -> Column:
    """struct with every weighted part and the total."""
    w = weights
    parts = {
        "format": reward_format(parsed) * w["format"], "tool": reward_tool_call(parsed, expected_tool, allowed) * w["tool"],
        "slot": reward_slot_filling(parsed, expected_slots) * w["slot"], "grounding": reward_grounding(claims) * w["grounding"],
        "hallucination": phantom_penalty(claims) * w["hallucination"], "refusal": reward_refusal(text, should_refuse) * w["refusal"],
        "length": length_overrun(text, target_length) * -w["length"],
    }
    total = None
    for c in parts.values():
        total = c if total is None else total + c
    return F.struct(total.alias("total"), *[c.alias(n) for n, c in parts.items()])


def dpo_terms(pc: Column, pr: Column, rc: Column, rr: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """Per-pair rewards, loss and hit from policy and reference log-probabilities, with a stable log-sigmoid."""
    def neg_log_sigmoid(x: Column) -> Column:
        return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

    c, r = (pc - rc) * beta, (pr - rr) * beta
    d = c - r
    loss = neg_log_sigmoid(d) * (1 - smoothing) + neg_log_sigmoid(-d) * smoothing if smoothing > 0 else neg_log_sigmoid(d)
    return F.struct(c.alias("reward_chosen"), r.alias("reward_rejected"), d.alias("margin"), loss.alias("loss"), (c > r).cast("double").alias("hit"))
