"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle where SQL has one."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return register


def _load() -> None:
    from quillspark.plans import answers, booklet, corpus, layout, pages, patterns, questions, study  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
