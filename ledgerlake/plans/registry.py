"""Registry of the finance queries: each has a DataFrame function and, where SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.roles import ROLES, execution, table, with_roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Roles:
    """The finance tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def execution(self, *keys: str) -> DataFrame:
        return execution(self.spark, self.sf_dir, *keys)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return ROLES[name](self.spark, self.sf_dir)
        raise AttributeError(name)


def query(sql: str | None = None):
    """Register a function of ``Roles`` under its own name."""

    def add(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_roles(sql)
        return f

    return add
