"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, *needs: str):
    """Registers f(Views) under its name with the DuckDB statement that gives the same rows."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *needs)
        return f

    return register


def rnd(c: str | Column, d: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, d)
