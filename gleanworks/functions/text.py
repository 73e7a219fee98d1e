"""Column expressions over text. Lengths and offsets count code points."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from .. import lexicons as lx


# Whitespace removed at both ends of a text: what a Unicode-aware strip removes.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007" \
             "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lit_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """One disjunction of ``contains`` calls: stays inside code generation, unlike a lambda over an array."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def first_hit(text: Column, words: Sequence[str]) -> Column:
    """First listed word occurring in ``text``, else NULL."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def first_text(messages: Column, position: int) -> Column:
    """First text part of the message at ``position`` (0 = user, 1 = assistant); NULL if there is none."""
    parts = F.filter(F.get(messages, F.lit(position))["content"], lambda p: p["type"] == "text")
    return F.get(parts, F.lit(0))["text"]


def script_share(text: Column, ranges: str = lx.CJK_RANGE) -> Column:
    """Share of characters inside a character-class range."""
    inside = F.length(F.regexp_replace(text, f"[^{ranges}]", ""))
    return inside / F.greatest(F.length(text), F.lit(1))


def has_contact(text: Column, patterns: Sequence[str] = lx.CONTACT_PATTERNS) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?U)" + p)
    return out


def half_repeat(text: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    same = F.substr(text, F.lit(1), half) == F.substr(text, half + 1, half)
    return (F.length(text) > 40) & same


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Set of character n-grams, in linear time: characters are cut once and neighbours put together."""
    t = strip(text)
    chars, count = F.split(t, ""), F.length(t) - n + 1
    grams = F.slice(chars, F.lit(1), count)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), count), lambda x, y: F.concat(x, y))
    return F.when(F.length(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def ngram_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    ga, gb = char_ngrams(a, n), char_ngrams(b, n)
    short = (F.length(strip(a)) < n) | (F.length(strip(b)) < n)
    return (F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), F.lit(0.0))
            .when(strip(a) == strip(b), F.lit(1.0)).when(short, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb))))


def norm_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / longest)


def contained(answer: Column, gold: Column) -> Column:
    return F.when((F.length(gold) > 0) & answer.contains(gold), F.lit(1.0)).otherwise(F.lit(0.0))


# How an answer is scored against one gold answer, both normalised, by kind of suite; callers may add or replace kinds.
SCORERS: Mapping[str, Callable[[Column, Column], Column]] = {"choice": contained, "yesno": contained, "ocr": edit_similarity}


def score_answer(answer: Column, golds: Column, kind: str, scorers: Mapping[str, Callable[[Column, Column], Column]] = SCORERS) -> Column:
    """Best score over the gold answers by the scorer of the kind."""
    a = norm_text(answer)
    return F.coalesce(F.array_max(F.transform(golds, lambda g: scorers[kind](a, norm_text(g)))), F.lit(0.0))


def strip_markers(text: Column, markers: Sequence[str]) -> Column:
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(""))
    return text


_PHONE = r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
_CARD = r"(?<!\d)(\d{6})\d{8}(\d{4})(?!\d)"


def mask_pii(text: Column) -> Column:
    out = F.regexp_replace(text, _PHONE, "$1****$2")
    out = F.regexp_replace(out, _CARD, "$1********$2")
    return strip(strip_markers(out, lx.CONTROL_MARKERS))


def postprocess_reply(text: Column) -> Column:
    """Mask phones, remove control markers, delete sentences in which the model discloses itself."""
    out = strip_markers(F.regexp_replace(text, _PHONE, "$1****$2"), lx.REPLY_MARKERS)
    return strip(F.regexp_replace(out, "作为(一个)?AI[^。！？]*[。！？]?", ""))


def cell(text: Column, width: int = 90) -> Column:
    """One table cell: line breaks and pipes replaced, cut with an ellipsis."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("／"))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)


def sample_id(*fields: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *fields).cast("binary")), 1, 16)


def canonical_json(text: Column) -> Column:
    """The same value with the keys of every object, nested ones too, in order, and no blanks; NULL if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def idempotency_key(session: Column, tool: Column, args: Column) -> Column:
    """Key of a call that ignores the order of arguments at every depth. ``args``: JSON text."""
    return F.substring(F.sha2(F.concat_ws("|", session, tool, F.coalesce(canonical_json(args), args)), 256), 1, 16)


def parse_yes_no(answer: Column, yes: Sequence[str] = lx.YES_WORDS, no: Sequence[str] = lx.NO_WORDS) -> Column:
    """TRUE/FALSE from the start of the answer, then from unambiguous containment, else NULL."""
    a = strip(answer)
    head = F.substring(a, 1, 20)

    def starts(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | head.startswith(w)
        return out

    has_y, has_n = contains_any(a, yes), contains_any(a, no)
    return (F.when(starts(yes), F.lit(True)).when(starts(no), F.lit(False))
            .when(has_y & ~has_n, F.lit(True)).when(has_n & ~has_y, F.lit(False)))
