"""Query registry: key -> (Spark builder, DuckDB oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame of flat scalar
columns. Oracle SQL runs on DuckDB over the same parquet tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("q_marts", "q_meals", "q_nutrition", "q_pantry",
           "q_memory", "q_vectors", "q_evals", "q_scheduling", "q_quality",
           "q_functions", "q_sources", "q_streaming", "q_plandocs")


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


_loaded = False


def load_all() -> None:
    global _loaded
    if _loaded:
        return
    for m in MODULES:
        importlib.import_module(f"larder.plans.{m}")
    _loaded = True
