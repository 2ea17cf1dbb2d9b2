"""The library's own queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import bound, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder as attributes: t.lineitem, t.b_findings."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bound(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register f(tables) under its name, with DuckDB SQL for its rows."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return put
