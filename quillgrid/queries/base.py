"""Helpers for registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def per_row(self, name: str, table: str, keys: str, build: Callable[[], Column], sql: str, kind: str = "double") -> None:
        """One value for each row.  Doubles are rounded to 6 places on both sides, since libraries differ in the last bit."""
        names = keys.split(",")
        duck = {"double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "bigint": "BIGINT"}[kind]

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            value = build().cast(kind)
            return read(spark, sf_dir, table).select(*names, (F.round(value, 6) + F.lit(0.0) if kind == "double" else value).alias("value"))

        value = f"round(CAST({sql} AS DOUBLE), 6) + 0.0" if kind == "double" else f"CAST({sql} AS {duck})"
        self.add(name, query, f"SELECT {keys}, {value} AS value FROM {table}")

    def grouped(self, name: str, table: str, by: str, build: Callable[[], Column], sql: str, digits: int = 4) -> None:
        """One double for each key."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return read(spark, sf_dir, table).groupBy(*by.split(",")).agg(F.round(build().cast("double"), digits).alias("value"))

        self.add(name, query, f"SELECT {by}, round(CAST({sql} AS DOUBLE), {digits}) AS value FROM {table} GROUP BY {by}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


c = F.col
