"""Named queries: one Spark callable per operator key and, where the
operation can be written in SQL, an independent DuckDB oracle query."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from attrition.session import apply_engine_conf
            return fn(apply_engine_conf(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from attrition.plans import q_prep, q_stats, q_eval, q_risk, q_model, q_io  # noqa: F401
