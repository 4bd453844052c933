"""Registered queries: every operator over the driver tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries and, where SQL can say the same, their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build() -> Catalog:
    from factloom.catalog import corpus, profiles, scores, statements, templates

    catalog = Catalog()
    for module in (statements, corpus, profiles, scores, templates):
        module.register(catalog)
    return catalog
