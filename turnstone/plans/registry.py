"""Registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.plans import oracle_base
from turnstone.plans.bridge import Tables, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None, *parts: str):
    """Register ``fn(tables) -> DataFrame`` and, when given, its SQL with the fragments it uses."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if check is not None:
            ORACLES[name] = oracle_base.sql(check, *parts)
        return fn
    return add


def r6(c) -> Column:
    """Doubles are compared after rounding: the order of a distributed sum is free."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def us(c: str) -> Column:
    return F.unix_micros(c)
