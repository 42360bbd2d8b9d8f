"""Every registered query and its SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and SQL.
MODULES = ("prices", "bets", "teams", "names", "models", "quality", "actions", "special", "ingest", "upkeep", "live", "streams")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"pitchside.plans.{name}"), what, {})
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest prices before the start, their value, and the best of them."""
    return queries()["top_01_by_ev"](spark, sf_dir)
