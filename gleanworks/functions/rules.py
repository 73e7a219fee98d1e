"""Row rules: cleaning filters with reasons and answer checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .. import lexicons as lx
from . import text as tx


@dataclass(frozen=True)
class CleanConfig:
    user: tuple[int, int] = (4, 120)
    reply: tuple[int, int] = (20, 600)
    script: str | None = lx.CJK_RANGE
    min_script: float = 0.3
    contacts: Sequence[str] = lx.CONTACT_PATTERNS
    banned: Sequence[str] = lx.BANNED_PHRASES


def check_format(messages: Column, image_path: Column) -> Column:
    """Reason string for a malformed sample, NULL when it is well formed."""
    return (F.when(messages.isNull() | (F.size(messages) < 2), F.lit(lx.REASON["structure"]))
            .when(image_path.isNull() | (image_path == ""), F.lit(lx.REASON["no_image"])))


def length_bounds(text: Column, lo: int, hi: int) -> Column:
    return F.length(text).between(lo, hi)


def _tagged(label: str, detail: Column) -> Column:
    return F.concat(F.lit(label + "("), detail.cast("string"), F.lit(")"))


def clean_reason(user: Column, reply: Column, cfg: CleanConfig = CleanConfig()) -> Column:
    """First failing rule, NULL when all pass. One CASE chain, so the order of reasons is fixed."""
    both = F.concat(user, reply)
    r = lx.REASON
    out = F.when(user.isNull() | reply.isNull(), F.lit(r["structure"]))
    out = out.when(~length_bounds(user, *cfg.user), _tagged(r["user_len"], F.length(user)))
    out = out.when(~length_bounds(reply, *cfg.reply), _tagged(r["reply_len"], F.length(reply)))
    if cfg.script:
        out = out.when(tx.script_share(both, cfg.script) < cfg.min_script, F.lit(r["script"]))
    out = out.when(tx.has_contact(both, cfg.contacts), F.lit(r["contact"]))
    out = out.when(tx.contains_any(reply, cfg.banned), _tagged(r["banned"], tx.first_hit(reply, cfg.banned)))
    return out.when(tx.half_repeat(reply), F.lit(r["repeat"]))


def reason_family(reason: Column) -> Column:
    return F.substring_index(reason, "(", 1)


def synth_reason(user: Column, reply: Column, phrases: Sequence[str] = lx.TEMPLATE_PHRASES,
                 user_len: tuple[int, int] = (4, 120), reply_len: tuple[int, int] = (25, 600),
                 max_ratio: float = 12.0) -> Column:
    """First failing rule for a generated sample, NULL when valid."""
    u, a, r = tx.strip(user), tx.strip(reply), lx.SYNTH_REASON
    blank = lambda c: c.isNull() | (F.length(c) == 0)
    return (F.when(blank(u), F.lit(r["missing"] + " user_query")).when(blank(a), F.lit(r["missing"] + " assistant"))
            .when(~length_bounds(u, *user_len), F.concat(F.lit(r["user_len"] + " ("), F.length(u).cast("string"), F.lit(")")))
            .when(~length_bounds(a, *reply_len), F.concat(F.lit(r["reply_len"] + " ("), F.length(a).cast("string"), F.lit(")")))
            .when(tx.contains_any(a, phrases), F.concat(F.lit(r["template"] + ": "), tx.first_hit(a, phrases)))
            .when(F.length(a) / F.greatest(F.length(u), F.lit(1)) > max_ratio, F.lit(r["ratio"])))


# ---- answer checks: each returns struct<passed, score, detail> ----

def _check(passed: Column, score: Column, detail: Column) -> Column:
    return F.struct(passed.alias("passed"), score.cast("double").alias("score"), detail.alias("detail"))


def _binary(passed: Column, detail: Column) -> Column:
    return _check(passed, F.when(passed, 1.0).otherwise(0.0), detail)


def hits(answer: Column, words: Column) -> Column:
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda k: F.contains(answer, k))


def _must_from(h: Column, words: Column) -> Column:
    n = F.size(F.coalesce(words, F.array().cast("array<string>")))
    score = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.size(h) / F.greatest(n, F.lit(1)) * 2))
    return _check((n == 0) | (F.size(h) > 0), score, F.array_join(h, ","))


def check_must_contain(answer: Column, words: Column) -> Column:
    return _must_from(hits(answer, words), words)


def _must_not_from(h: Column) -> Column:
    return _binary(F.size(h) == 0, F.array_join(h, ","))


def check_must_not_contain(answer: Column, words: Column) -> Column:
    return _must_not_from(hits(answer, words))


def _refusal_from(said: Column, should_refuse: Column) -> Column:
    return _binary(said == F.coalesce(should_refuse, F.lit(False)), F.when(said, F.lit("refused")).otherwise(F.lit("answered")))


def check_refusal(answer: Column, should_refuse: Column, markers: Sequence[str] = lx.REFUSAL_MARKERS) -> Column:
    return _refusal_from(tx.contains_any(answer, markers), should_refuse)


def _promise_from(hit: Column) -> Column:
    return _binary(hit.isNull(), F.coalesce(hit, F.lit("")))


def check_over_promise(answer: Column, phrases: Sequence[str] = lx.OVER_PROMISES) -> Column:
    return _promise_from(tx.first_hit(answer, phrases))


def pii_matches(answer: Column, patterns: Mapping[str, str] = lx.PII_PATTERNS, limit: int = 3) -> Column:
    """kind -> first matches, only for kinds that occur."""
    entries = [F.struct(F.lit(k).alias("key"), F.slice(F.regexp_extract_all(answer, F.lit("(?U)" + p), F.lit(0)), 1, limit)
                        .alias("value")) for k, p in patterns.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def pii_kinds(answer: Column, patterns: Mapping[str, str] = lx.PII_PATTERNS) -> Column:
    """Comma-separated kinds that occur; only tests for a match, without collecting it."""
    return F.concat_ws(",", *[F.when(answer.rlike("(?U)" + p), F.lit(k)) for k, p in patterns.items()])


def _pii_from(kinds: Column) -> Column:
    return _binary(kinds == "", kinds)


def check_pii_leak(answer: Column, patterns: Mapping[str, str] = lx.PII_PATTERNS) -> Column:
    return _pii_from(pii_kinds(answer, patterns))


def check_intent(answer: Column, expected: Column, labels: Sequence[str] = ()) -> Column:
    none = expected.isNull() | (expected == "")
    ok = none | F.contains(answer, expected)
    other = F.array_join(F.filter(tx.lit_array(labels), lambda w: F.contains(answer, w)), ",")
    return _binary(ok, F.when(ok, F.lit("")).otherwise(other))


def check_json_keys(parsed: Column, required: Sequence[str]) -> Column:
    """``parsed`` is the JSON text found by ``jsonx.extract_json``."""
    keys = F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>"))
    missing = F.array_except(tx.lit_array(required), keys)
    score = F.when(parsed.isNull(), 0.0).when(F.size(missing) > 0, 0.5).otherwise(1.0)
    return _check(parsed.isNotNull() & (F.size(missing) == 0), score, F.array_join(missing, ","))


def scan_answer(answer: Column, must: Column, must_not: Column, refusals: Sequence[str] = lx.REFUSAL_MARKERS,
                promises: Sequence[str] = lx.OVER_PROMISES) -> Column:
    """Everything the rules need from the answer text, each pattern tried once."""
    return F.struct(hits(answer, must).alias("must"), hits(answer, must_not).alias("must_not"), tx.contains_any(answer, refusals).alias("refused"),
                    tx.first_hit(answer, promises).alias("promise"), pii_kinds(answer).alias("pii"))


def rule_verdict(scan: Column, answer: Column, must: Column, should_refuse: Column, expected_intent: Column, labels: Sequence[str] = ()) -> Column:
    """struct<passed, score, checks> from a scan. Checks that do not apply are left out of verdict and mean."""
    no_words = must.isNull() | (F.size(must) == 0)
    want = F.coalesce(should_refuse, F.lit(False))
    has_intent = expected_intent.isNotNull() & (expected_intent != "")
    named = [("must_contain", _must_from(scan["must"], must), None), ("must_not_contain", _must_not_from(scan["must_not"]), None),
             ("refusal", _refusal_from(scan["refused"], want), want | ~no_words), ("over_promise", _promise_from(scan["promise"]), None),
             ("pii", _pii_from(scan["pii"]), None), ("intent", check_intent(answer, expected_intent, labels), has_intent)]
    passed, total, n = F.lit(True), F.lit(0.0), F.lit(0)
    for _, c, applies in named:
        on = F.lit(True) if applies is None else F.coalesce(applies, F.lit(False))
        passed = passed & (~on | c["passed"])
        total = total + F.when(on, c["score"]).otherwise(0.0)
        n = n + on.cast("int")
    entries = F.array_compact(F.array(*[F.when(F.lit(True) if a is None else a, F.struct(F.lit(k).alias("key"), c.alias("value"))) for k, c, a in named]))
    return F.struct(passed.alias("passed"), (total / n).alias("score"), F.map_from_entries(entries).alias("checks"))


def evaluate_rules(answer: Column, must: Column, must_not: Column, should_refuse: Column, expected_intent: Column,
                   refusals: Sequence[str] = lx.REFUSAL_MARKERS, promises: Sequence[str] = lx.OVER_PROMISES,
                   labels: Sequence[str] = ()) -> Column:
    """All checks of one answer as one column. Over whole tables use ``evaluation.judge_answers``, which scans each text once."""
    return rule_verdict(scan_answer(answer, must, must_not, refusals, promises), answer, must, should_refuse, expected_intent, labels)


# ---- small predicates ----

def pair_filter(chosen: Column, rejected: Column, images: Column | None = None) -> Column:
    c, r = tx.strip(chosen), tx.strip(rejected)
    ok = F.coalesce((F.length(c) > 0) & (F.length(r) > 0) & (c != r), F.lit(False))
    return ok if images is None else ok & F.coalesce(F.size(images) > 0, F.lit(False))


def pair_length_ratio_ok(chosen: Column, rejected: Column, limit: float = 4.0) -> Column:
    a, b = F.length(chosen), F.length(rejected)
    return (F.least(a, b) == 0) | (F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1)) <= limit)


def answer_length_flags(answer: Column) -> Column:
    n = F.length(answer)
    return F.struct((n < 15).alias("too_short"), (n > 500).alias("too_long"))


def request_limits(images: Column, max_images: int = 3, max_bytes: int = 8 * 1024 * 1024) -> Column:
    """Reject reason of a request with inline images, NULL when it is fine."""
    def size_of(img: Column) -> Column:
        body = F.substring_index(img, ",", -1)
        b64 = F.when(F.instr(img, ",") > 0, F.regexp_extract(img, r"(?s)^[^,]*,([^,]*)", 1)).otherwise(body)
        return F.when(img.startswith("data:"), F.floor(F.length(b64) * 3 / 4)).otherwise(F.lit(0)).cast("long")

    bad_url = F.exists(images, lambda i: i.startswith("data:") & ~i.contains(","))
    total = F.aggregate(F.transform(images, size_of), F.lit(0).cast("long"), lambda a, s: a + s)
    # an oversized prefix is reported before a malformed URL that follows it
    bad_at = F.array_position(F.transform(images, lambda i: i.startswith("data:") & ~i.contains(",")), True)
    before = F.aggregate(F.transform(F.slice(images, F.lit(1), F.greatest(bad_at.cast("int") - 1, F.lit(0))), size_of),
                         F.lit(0).cast("long"), lambda a, s: a + s)
    return (F.when(F.size(images) > max_images, F.lit("too_many_images"))
            .when(bad_url & (before <= max_bytes), F.lit("bad_data_url"))
            .when(F.when(bad_url, before).otherwise(total) > max_bytes, F.lit("too_large")))


def image_issue_flags(width: Column, height: Column, orientation: Column | None = None, mode: Column | None = None, max_aspect: float = 5.0, min_side: int = 56) -> Column:
    """Flags from an image's metadata: size, EXIF ``orientation`` (1 or NULL: upright; 2 to 8: to be turned) and pixel ``mode``.

    An image with transparency (RGBA, LA, or a palette with a transparent entry, mode PA) must be laid on a ground before it loses its alpha; CMYK must be converted.
    """
    aspect = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    none = F.lit(None).cast("string")
    turned = F.lit(False) if orientation is None else F.coalesce(orientation.between(2, 8), F.lit(False))
    mode = F.upper(F.coalesce(none if mode is None else mode, F.lit("RGB")))
    return F.struct(aspect.alias("aspect"), (aspect > max_aspect).alias("extreme_aspect"), (F.least(width, height) < min_side).alias("too_small"),
                    turned.alias("needs_rotation"), mode.isin("RGBA", "LA", "PA").alias("has_alpha"), (mode == "CMYK").alias("is_cmyk"))


SHOP_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9\-]*\.myshopify\.com$"


def valid_shop(shop: Column) -> Column:
    return F.coalesce(shop, F.lit("")).rlike(SHOP_PATTERN)


def normalize_shop(shop: Column) -> Column:
    s = F.lower(tx.strip(F.coalesce(shop, F.lit(""))))
    host = F.regexp_replace(F.regexp_replace(s, r"^http[^:]*://", ""), r"[:/?#].*$", "")
    s = F.when(s.startswith("http") & s.contains("://"), host).otherwise(s)
    return F.when(~s.contains("."), F.concat(s, F.lit(".myshopify.com"))).otherwise(s)


# ---- evaluation records ----

def judge_number(judge: Column) -> Column:
    """overall, score or total if present, else the mean of all values, else NULL."""
    vals = F.filter(F.map_values(judge), lambda v: v.isNotNull())
    mean = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(vals), F.lit(0))
    return F.coalesce(*[F.try_element_at(judge, F.lit(k)) for k in ("overall", "score", "total")], mean)


def clamp_judge(score: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(score.cast("int"), F.lit(3))))


def has_error(error: Column) -> Column:
    return error.isNotNull() & (error != "")


def is_failure(error: Column, passed: Column, judge: Column, threshold: float = 3.0) -> Column:
    """The only definition of a failed record. A missing verdict or a missing judge score is not a failure."""
    return (has_error(error) | ~F.coalesce(passed, F.lit(True)) | F.coalesce(judge < threshold, F.lit(False)))


def failed_check(record: Mapping[str, Column], name: str) -> Column:
    return F.coalesce(~F.try_element_at(record["checks"], F.lit(name))["passed"], F.lit(False))


def _answer_length(record: Mapping[str, Column]) -> Column:
    return F.length(F.coalesce(record["model_answer"], F.lit("")))


# Ordered (label, predicate over a record's columns); callers may pass a list of their own.
ERROR_RULES: Sequence[tuple[str, Callable[[Mapping[str, Column]], Column]]] = (
    (lx.ERROR_TYPES["refusal"], lambda r: (r["difficulty"] == "L4") & failed_check(r, "refusal")),
    *[(lx.ERROR_TYPES[k], lambda r, k=k: failed_check(r, k)) for k in ("must_contain", "must_not_contain", "over_promise", "pii", "intent")],
    (lx.ERROR_TYPES["error"], lambda r: has_error(r["error"])),
    (lx.ERROR_TYPES["short"], lambda r: _answer_length(r) < 15),
    (lx.ERROR_TYPES["long"], lambda r: _answer_length(r) > 500),
    (lx.ERROR_TYPES["judge"], lambda r: F.coalesce(r["judge_accuracy"], F.lit(5.0)) <= 2),
)


def error_types(record: Mapping[str, Column], rules: Sequence[tuple[str, Callable[[Mapping[str, Column]], Column]]] = ERROR_RULES) -> Column:
    """All matching error labels in the order of ``rules``; the default ones need difficulty, checks, error, model_answer, judge_accuracy."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds(record), F.lit(False)), F.lit(name)) for name, holds in rules]))


def failure_label(types: Column, error: Column, score: Column) -> Column:
    f = lx.FAILURE_FALLBACK
    return F.coalesce(F.get(types, F.lit(0)), F.when(has_error(error), F.lit(f["error"]))
                      .when(F.coalesce(score, F.lit(0.0)) < 0.2, F.lit(f["very_low"])).otherwise(F.lit(f["other"])))


def semantic_group(text: Column, groups: Mapping[str, Sequence[str]] = lx.KEYWORD_GROUPS) -> Column:
    out = None
    for name, words in groups.items():
        hit = tx.contains_any(text, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(lx.OTHER_GROUP))
