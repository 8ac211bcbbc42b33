"""Registry of runnable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.sqlbase import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``tables`` names the stand-ins its SQL uses."""
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(tables or "", sql)
        return run

    return keep


def text(column: str, out: str | None = None) -> Column:
    """Column as text (dates and instants compare as ISO text)."""
    return F.col(column).cast("string").alias(out or column)


def joined(column: str | Column, out: str, by: str = ",") -> Column:
    """Array of scalars as one text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by).alias(out)


def instant(column: str, out: str | None = None) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(out or column)
