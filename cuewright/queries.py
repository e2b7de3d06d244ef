"""Registered queries of the engine over the given tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that must give its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from cuewright.plans import action_queries, audit_queries, curation_queries, job_queries, record_queries, rollout_queries  # noqa: F401

    return QUERIES, ORACLES
