"""Registry of queries and their SQL oracles."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.data import Data
from checks.sql import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, **steps: str):
    """Register ``f(data) -> DataFrame`` under ``name``, with its oracle if SQL can say it.

    ``steps`` are named subqueries of this oracle alone.
    """

    def register(build: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = query(sql, **steps)
        return build

    return register
