"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query under ``name``, with DuckDB SQL where SQL can state it."""

        def deco(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return deco

    def spark_sql(self, name: str, sql: str, oracle: str | None = None) -> None:
        """Register a query whose Spark text and oracle text are the same, or differ only in spelling."""
        from lakeloom.sources.tables import register_views

        def run(spark: SparkSession, sf: str, text: str = sql) -> DataFrame:
            return spark.sql(register_views(spark, sf, text))

        self.add(name, sql if oracle is None else oracle)(run)
