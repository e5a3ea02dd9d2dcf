"""The operators' queries over their whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> the module of this package that has a function of that name
#: and, where SQL can express the query, ``ORACLE_SQL``.
_MODULES = {
    "op1_ngram_join": "ngram_join",
    "op2_line_dedup": "line_dedup",
    "op3_pii": "pii",
    "op4_quality_classifier": "quality_classifier",
    "op5_preference_format": "preference_format",
    "op6_substring_dedup": "substring_dedup",
    "op7_quality_rules": "quality_rules",
    "op8_byte_bpe": "bpe",
    "op9_decontaminate": "decontaminate",
    "op10_license_scan": "license_scan",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{m}"), name) for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE_SQL", None) for name, m in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
