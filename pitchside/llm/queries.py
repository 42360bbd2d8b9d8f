"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and, where SQL can express them, SQL.
MODULES = (
    "line_dedup",
    "suffix_dedup",
    "private_data",
    "fingerprints",
    "quality",
    "prob_minhash",
    "mixing",
    "permutation_index",
    "licenses",
    "tokens",
    "toxicity",
    "manifest",
    "conversation_trie",
)


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"pitchside.llm.{name}"), what, {})
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
