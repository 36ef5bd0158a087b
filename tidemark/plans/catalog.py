"""Registry of runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scoring import publish

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the equivalent statement, if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def flat(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Result columns in engine-neutral types: text dates, 64-bit integers, doubles rounded to `digits` (None: as they are)."""
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "date":
            c = c.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = c.cast("double") if digits is None else publish(c.cast("double"), digits)
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for m in ("theme_queries", "display_queries", "portfolio_queries", "research_queries", "news_queries", "contract_queries", "stream_queries", "source_queries"):
        import_module(f"tidemark.plans.{m}")
