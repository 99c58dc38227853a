"""Registry of named queries: (spark, sf_dir) -> DataFrame, each with its
independent DuckDB oracle SQL (where the operator is expressible in SQL).

Compared columns are plain scalars: integers BIGINT, floats rounded DOUBLE,
arrays joined into strings, no wall-clock timestamps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn`` under ``key`` with an optional oracle SQL string."""
    def wrap(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return wrap


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (queries_changes, queries_corpus, queries_io, queries_ledger, queries_meta,  # noqa: F401
                   queries_retrieval, queries_stream, queries_tokens)
