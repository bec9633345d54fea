"""The register of queries: each has a name, the operators it shows, and its SQL twin if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cyclora.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None):
    """Registers a function of Tables under its name. operators: the ids it shows."""

    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        OPERATORS[name] = operators
        if sql:
            ORACLES[name] = sql
        return f

    return register
