"""Finding a JSON object inside free text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import text as tx

_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def _parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _scan(text: str) -> str | None:
    """First balanced brace block that parses. One pass pairs the braces, so nested openings are not rescanned."""
    stack: list[int] = []
    close: dict[int, int] = {}
    for i, ch in enumerate(text):
        if ch == "{":
            stack.append(i)
        elif ch == "}" and stack:
            close[stack.pop()] = i
    for start in sorted(close):
        block = text[start:close[start] + 1]
        try:
            json.loads(block)
            return block
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _scan_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None or "{" not in t else _scan(t))


def extract_json(text: Column) -> Column:
    """JSON text: the whole string, else a fenced block, else the first balanced block that parses, else NULL.

    Only rows the two native stages leave open are sent to Python.
    """
    whole = F.when(_parses(tx.strip(text)), tx.strip(text))
    block = F.regexp_extract(text, _FENCE, 1)
    native = F.coalesce(whole, F.when((block != "") & _parses(block), block))
    return F.coalesce(native, _scan_udf(F.when(native.isNull() & text.contains("{"), text)))


def is_object(parsed: Column) -> Column:
    return F.coalesce(parsed.isNotNull() & tx.strip(parsed).startswith("{"), F.lit(False))


def keys(parsed: Column) -> Column:
    return F.coalesce(F.when(is_object(parsed), F.json_object_keys(parsed)), F.array().cast("array<string>"))
