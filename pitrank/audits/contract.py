"""Checks of canonical and landed tables. Each rule is an aggregate that returns a count, never the rows themselves."""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import BENCHMARKS, FUNDAMENTALS, RETURNS
from ..sources.canonical import Panel

METADATA_KEYS = ("name", "display_name", "coverage_start", "coverage_end", "is_simulated", "survivorship_bias", "caveats")


class ContractError(ValueError):
    pass


def schema_problems(df: DataFrame, expected: StructType) -> list[str]:
    """Missing columns and wrong types; further columns are allowed. Looks at the schema only, no job runs."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [f"{f.name}: missing" for f in expected.fields if f.name not in have]
    return out + [f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
                  for f in expected.fields if f.name in have and have[f.name] != f.dataType]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once and how often; partial counts are formed before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _rule(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def _stack(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def returns_violations(returns: DataFrame) -> DataFrame:
    """Month-end dates, unique keys, at most one delisting per security and only on its last row."""
    flag = F.col("is_delisted_this_month")
    per = returns.groupBy("security_id").agg(
        F.count_if(flag).alias("flags"), F.max("date").alias("last"), F.max(F.when(flag, F.col("date"))).alias("flagged"))
    return _stack([
        _rule("month_end", returns.where(F.col("date") != F.last_day("date"))),
        _rule("unique_key", duplicate_keys(returns, ["security_id", "date"])),
        _rule("one_delisting", per.where(F.col("flags") > 1)),
        _rule("delisting_is_last", per.where(F.col("flagged") != F.col("last")))])


def fundamentals_violations(fundamentals: DataFrame) -> DataFrame:
    return _stack([
        _rule("published_after_period", fundamentals.where(F.col("available_date") < F.col("fiscal_period_end"))),
        _rule("unique_key", duplicate_keys(fundamentals, ["security_id", "fiscal_period_end", "available_date"]))])


def benchmarks_violations(benchmarks: DataFrame) -> DataFrame:
    return _stack([_rule("month_end", benchmarks.where(F.col("date") != F.last_day("date"))),
                   _rule("unique_key", duplicate_keys(benchmarks, ["date"]))])


def contract_counts(panel: Panel) -> DataFrame:
    """Rows, securities and date range per table."""
    def counts(name: str, df: DataFrame, date: str, ids: bool = True) -> DataFrame:
        n = F.countDistinct("security_id") if ids else F.lit(0).cast("long")
        return df.agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n_securities"), F.min(date).alias("date_min"),
                      F.max(date).alias("date_max")).select(F.lit(name).alias("table_name"), "*")
    return _stack([counts("returns", panel.returns, "date"),
                   counts("fundamentals", panel.fundamentals, "available_date"),
                   counts("benchmarks", panel.benchmarks, "date", ids=False)])


def check_contract(panel: Panel, metadata: Mapping[str, object]) -> dict[str, int]:
    """Raises on any violation; returns row counts. The collected rows are one per rule or table."""
    lacking = [k for k in METADATA_KEYS if k not in metadata]
    if lacking:
        raise KeyError(f"metadata lacks {lacking}")
    checks = {"returns": (panel.returns, RETURNS, returns_violations),
              "fundamentals": (panel.fundamentals, FUNDAMENTALS, fundamentals_violations),
              "benchmarks": (panel.benchmarks, BENCHMARKS, benchmarks_violations)}
    for name, (df, schema, rules) in checks.items():
        problems = schema_problems(df, schema)
        problems += [f"{r.rule}: {r.violations} violations" for r in rules(df).where("violations > 0").collect()] if not problems else []
        if problems:
            raise ContractError(f"{name}: " + "; ".join(problems))
    return {r.table_name: r.n_rows for r in contract_counts(panel).collect()}


def expected_columns(spark: SparkSession, tables: Mapping[str, DataFrame | None], expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per expected column (found or not) and one per table with the further columns; schema metadata only."""
    rows = []
    for name, columns in expected.items():
        df = tables.get(name)
        have = {c.lower() for c in df.columns} if df is not None else set()
        if df is None:
            rows.append((name, "*", True, False, "table not found"))
            continue
        rows += [(name, c, True, c.lower() in have, "") for c in columns]
        rows.append((name, "(others)", False, True, ", ".join(sorted(have - {c.lower() for c in columns}))))
    return spark.createDataFrame(rows, "table_name string, column_name string, expected boolean, found boolean, note string")
