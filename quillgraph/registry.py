"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(get) -> DataFrame``; ``get(view)`` loads a view or table, ``get.spark`` is the session."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Source(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = facts.plain_sql(sql)
        return fn

    return wrap


def surface(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query of the SQL surface: one text for both engines, or one each where the dialects differ."""
    QUERIES[name] = lambda spark, sf_dir: facts.spark_sql(spark, sf_dir, spark_sql)
    ORACLE[name] = facts.plain_sql(oracle or spark_sql)


class Source:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return facts.load(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return facts.spark_sql(self.spark, self.sf_dir, text)
