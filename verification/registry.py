"""Collects the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a query; `sql` is the equivalent over the tables and views, `ctes` what it builds on."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            # Views that only the extra CTEs mention count as well.
            full = with_views(sql + "\n/*" + "\n".join(ctes) + "*/", *ctes, recursive=recursive)
            ORACLES[name] = full[:full.index("\n/*")]
        return fn

    return add
