"""Signatures and look-up phrases of the shop side, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BLOCK = 64


def hmac_sha256(message: Column, secret: str) -> Column:
    """HMAC-SHA256 as binary. The key is a constant, so both padded keys are literals and everything stays in the JVM."""
    import hashlib

    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    digest = lambda b: F.unhex(F.sha2(b, 256))
    return digest(F.concat(F.lit(outer), digest(F.concat(F.lit(inner), message))))


def body_signature(body: Column, secret: str) -> Column:
    return F.base64(hmac_sha256(body, secret))


def same_signature(expected: Column, received: Column) -> Column:
    """Compare hashes of both sides, so that the time taken says nothing about a common prefix."""
    received = F.coalesce(received, F.lit(""))
    return F.sha2(F.encode(expected, "utf-8"), 256) == F.sha2(F.encode(received, "utf-8"), 256)


def valid_body(body: Column, signature: Column, secret: str) -> Column:
    return F.lit(False) if not secret else F.coalesce(same_signature(body_signature(body, secret), signature), F.lit(False))


def query_parts(query: Column) -> Column:
    """Decoded array<struct<k, v>> of a query string; of a repeated key the last value stays."""
    plus = lambda c: F.try_url_decode(c)
    raw = F.filter(F.split(query, "&"), lambda s: F.length(s) > 0)
    pairs = F.transform(raw, lambda s: F.struct(plus(F.substring_index(s, "=", 1)).alias("k"),
                                                plus(F.when(s.contains("="), F.regexp_replace(s, r"(?s)^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))


def valid_query(query: Column, secret: str) -> Column:
    """Signed callback: the ``hmac`` parameter signs the other parameters in key order, as hex."""
    if not secret:
        return F.lit(False)
    parts = query_parts(query)
    given = F.get(F.filter(parts, lambda p: p["k"] == "hmac"), F.lit(0))["v"]
    rest = F.array_sort(F.filter(parts, lambda p: p["k"] != "hmac"))
    message = F.array_join(F.transform(rest, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    mine = F.lower(F.hex(hmac_sha256(F.encode(message, "utf-8"), secret)))
    return F.coalesce(same_signature(mine, given) & (given != ""), F.lit(False))


def days_since(date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, date)


def normalize_topic(topic: Column) -> Column:
    return F.replace(F.lower(topic), F.lit("_"), F.lit("/"))
