"""The registry of queries and the column helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLE_SQL[name] = oracle
        return function

    return keep


def r(c: str | Column, digits: int = 4, name: str | None = None) -> Column:
    """A double rounded for comparison; sums may come in any order."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column.cast("double"), digits) + 0.0).alias(name or c)  # no negative zero


def per(total: str | Column, count: str | Column, name: str) -> Column:
    """A total in cents over a count, zero for none; divided after rounding, so that order cannot matter."""
    total = F.col(total) if isinstance(total, str) else total
    count = F.col(count) if isinstance(count, str) else count
    return F.coalesce(F.try_divide(F.round(total, 2), count), F.lit(0.0)).alias(name)


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)
