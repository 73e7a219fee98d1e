"""Operators of a training-data pipeline and their queries. Nothing outside this folder imports it."""

from __future__ import annotations

import importlib

MODULES = ("decontamination", "exact_dedup", "near_dedup", "suffix_tree_lm", "toxicity", "url_filter", "quality", "sharding", "mixing", "license_scan", "periodic_runs", "warc", "token_alignment")


def load():
    """Import all operator modules and return (queries, SQL twins)."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    common = importlib.import_module(f"{__name__}.common")
    return common.QUERIES, common.SQL
