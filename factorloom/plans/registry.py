"""Collects the queries of this package's modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = ("panel", "study", "price_volume", "rules", "statements", "formulas", "formulas_191", "technical", "regressions", "risk", "selection", "stores", "held", "evaluation")


def queries() -> dict[str, Query]:
    """Every query by name."""
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"factorloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"factorloom.plans.{name}").SQL
    return found
