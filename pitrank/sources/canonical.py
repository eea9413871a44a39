"""Readers for the canonical tables. Bounds are plain predicates, so they reach the Parquet scan."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import BENCHMARKS, FUNDAMENTALS, FUNDAMENTALS_LEAD_MONTHS, LOOKBACK_MONTHS, RETURNS


def as_date(d: str | date | Column) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


YEAR = "year"


def between_dates(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows within the bounds. A table landed by year (``write_canonical``) is opened for those years only."""
    first, last = as_date(start), as_date(end)
    cut = df.where(F.col(column).between(first, last))
    if YEAR in df.columns:
        cut = cut.where(F.col(YEAR).between(F.year(first), F.year(last))).drop(YEAR)
    return cut


def returns_between(returns: DataFrame, start, end) -> DataFrame:
    return between_dates(returns, "date", start, end)


def fundamentals_between(fundamentals: DataFrame, start, end) -> DataFrame:
    """Filings published from 18 months before ``start``, so the figures in force at ``start`` are included."""
    return between_dates(fundamentals, "available_date",
                         F.add_months(as_date(start), -FUNDAMENTALS_LEAD_MONTHS), end)


def benchmarks_between(benchmarks: DataFrame, start, end) -> DataFrame:
    return between_dates(benchmarks, "date", start, end)


def month_ends(returns: DataFrame, start=None) -> DataFrame:
    """Distinct panel dates. One row per calendar month, whatever the number of securities."""
    df = returns.select("date")
    if start is not None:
        df = df.where(F.col("date") >= as_date(start))
    return df.distinct()


@dataclass(frozen=True)
class Panel:
    """The three canonical tables of one market, or of many when they carry the same key columns."""
    returns: DataFrame
    fundamentals: DataFrame
    benchmarks: DataFrame


def prepare_panel(panel: Panel, start, end) -> Panel:
    """Cut a panel to a backtest window, keeping the history trailing windows and prior-year lookups need.

    NaN becomes NULL here too, since panels are also put together by hand.
    """
    lead = F.add_months(as_date(start), -LOOKBACK_MONTHS)
    return Panel(clean_nan(returns_between(panel.returns, lead, end)),
                 clean_nan(fundamentals_between(panel.fundamentals, lead, end)),
                 clean_nan(benchmarks_between(panel.benchmarks, start, end)))


def read_panel(spark: SparkSession, path: str, by_year: bool = False) -> Panel:
    """Canonical tables landed as Parquet under one folder; schemas are stated, never inferred, and NaN is NULL.

    ``by_year``: the folders hold one partition per year of ``date`` or ``available_date``, as ``write_panel`` leaves
    them. The column stays until bounds are set (``prepare_panel``, ``between_dates``), which then open those years only.
    """
    def table(name: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField(YEAR, T.IntegerType())]) if by_year else schema
        return clean_nan(spark.read.schema(full).parquet(f"{path}/{name}"))
    return Panel(table("returns", RETURNS), table("fundamentals", FUNDAMENTALS), table("benchmarks", BENCHMARKS))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every double column."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double"))
                           for f in df.schema.fields if f.dataType.typeName() == "double"})
