"""Named queries of the core with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: modules that define QUERIES: name -> function, and ORACLES: name -> SQL
MODULES = tuple(f"casemill.queries.{m}" for m in ("orphans", "text", "graph", "retrieval", "evaluation", "lifting", "tables", "dockets"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(m).ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best precedents of every tenth case."""
    return queries()["fused_rank"](spark, sf_dir, every=10)
