"""Report helpers: searching, paging, generic browsing and whole-table comparison views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500


def matches(terms: dict[str, str], any_of: bool = False) -> Column:
    """Case-insensitive substring match of columns as text; all terms, or any."""

    def one(name: str, term: str) -> Column:
        return F.lower(F.col(name).cast("string")).contains(term.lower())

    tests = [one(n, t) for n, t in terms.items()]
    return reduce(lambda a, b: (a | b) if any_of else (a & b), tests) if tests else F.lit(True)


def page(rows: DataFrame, where: Column, order: list[str], page: int = 1, size: int = 50) -> DataFrame:
    """One page in a stable order, each row with the total of matching rows."""
    size = max(1, min(size, MOST_ROWS))
    kept = rows.where(F.coalesce(where, F.lit(False)))
    total = F.broadcast(kept.agg(F.count("*").alias("total")))  # one row
    return kept.orderBy(*order).offset(size * (max(1, page) - 1)).limit(size).crossJoin(total)


def browse(table: DataFrame, filters: dict[str, str], sort: str, descending: bool = False, page_no: int = 1, size: int = 50) -> DataFrame:
    """Any table: filter columns as text, sort, and page of at most 500 rows."""
    known = {n: t for n, t in filters.items() if n in table.columns}
    order = F.desc(sort) if descending else F.asc(sort)
    kept = table.where(F.coalesce(matches(known), F.lit(False)))
    size = max(1, min(size, MOST_ROWS))
    return kept.orderBy(order).offset(size * (max(1, page_no) - 1)).limit(size)


def search(customers: DataFrame, segments: DataFrame, cycles: DataFrame, term: str, most: int = 25) -> DataFrame:
    """Customers by id or country (the first ones in id order), segments and cycles whose text holds a term."""

    def names(rows: DataFrame, kind: str, column: str) -> DataFrame:
        found = rows.where(F.coalesce(matches({column: term}), F.lit(False))).select(F.col(column).alias("value")).distinct()
        return found.select(F.lit(kind).alias("kind"), "value", F.lit(None).cast("string").alias("detail"))

    hit = F.coalesce(matches({"customer_id": term}), F.lit(False)) | F.coalesce(matches({"country": term}), F.lit(False))
    first = customers.where(hit).orderBy("customer_id").limit(most)
    people = first.select(F.lit("customer").alias("kind"), F.col("customer_id").cast("string").alias("value"), F.col("country").alias("detail"))
    return people.unionByName(names(segments, "segment", "segment_name")).unionByName(names(cycles, "cycle", "cycle"))


def top(rows: DataFrame, measure: str, tie: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(measure), tie).limit(n)
