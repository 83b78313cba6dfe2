"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    from attrition.llm import queries  # noqa: F401
