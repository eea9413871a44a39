"""Shared pieces of the registered queries: output formatting and the registry."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


# A result layout is text: one word per column, "name" or "name:kind", where kind is
#   s text (default)   d date as ISO text   i 64-bit integer   b boolean   a digit: double rounded to so many places
def _parts(layout: str) -> list[tuple[str, str]]:
    return [(w.split(":") + ["s"])[:2] for w in layout.split()]


def present(df: DataFrame, layout: str) -> DataFrame:
    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("long")
        elif kind.isdigit():
            x = F.round(c.cast("double"), int(kind))
            c = F.when(x == 0, F.lit(0.0)).otherwise(x)
        return c.alias(name)
    return df.select(*[one(n, k) for n, k in _parts(layout)])


def columns_sql(layout: str) -> str:
    def one(name: str, kind: str) -> str:
        if kind == "d":
            return f"strftime({name}, '%Y-%m-%d') AS {name}"
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        if kind.isdigit():
            x = f"round(CAST({name} AS DOUBLE), {kind})"
            return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE {x} END AS {name}"
        return name
    return ", ".join(one(n, k) for n, k in _parts(layout))


def sql(layout: str, last: str, *ctes: str) -> str:
    """WITH <ctes> SELECT <layout> FROM <last>."""
    return f"WITH RECURSIVE {', '.join(ctes)}\nSELECT {columns_sql(layout)} FROM {last}" if ctes else \
        f"SELECT {columns_sql(layout)} FROM {last}"
