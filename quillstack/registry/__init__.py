"""Registered queries: each name binds an operator to the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.session import apply_session_conf

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its DuckDB counterpart."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(apply_session_conf(spark), folder)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"quillstack.registry.{module}")


MODULES = [
    "sources", "identity", "chunks", "vectors", "search", "collections", "versions", "web", "runlog", "notes",
    "texttools", "streams",
]
