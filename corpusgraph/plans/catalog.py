"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.sources.derived import Data, with_views

ENTRIES: dict[str, tuple[Callable[[Data], DataFrame], str | None]] = {}


def query(name: str, *views: str, sql: str | None = None, ctes: str = ""):
    """Register ``f(data) -> DataFrame``; ``ctes`` are further WITH members placed before ``sql``."""

    def register(f):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        text = None
        if sql is not None:
            head = with_views(*views)
            if ctes:
                head = (head + ",\n" if head else "WITH ") + ctes.strip().rstrip(",")
            joined = sql.strip()
            if joined.startswith(",") and not head:
                joined = "WITH " + joined[1:]
            text = f"{head}\n{joined}"
        ENTRIES[name] = (f, text)
        return f

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, folder: f(Data(spark, folder))

    return {name: bind(f) for name, (f, _) in ENTRIES.items()}


def check_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text is not None}
