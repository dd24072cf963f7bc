"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ["wal", "chains", "diff", "catalog", "operations", "fleet", "sites", "streams", "sources", "texts"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for f in FAMILIES for k, v in import_module(f"{__package__}.{f}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in import_module(f"{__package__}.{f}").SQL.items()}
