"""Registered queries of the event engine, with the SQL that states each one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import events, layout, stateful, streams

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (streams, layout, events, stateful)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
