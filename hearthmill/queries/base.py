"""Registration of named queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Named:
    """Two dictionaries, filled by a decorator."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Query) -> Query:
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return add
