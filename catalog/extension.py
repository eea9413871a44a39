"""What a user adds and declares: a factor of their own, and tables compared with stated schemas."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pitrank.audits.contract import contract_counts, expected_columns, schema_problems
from pitrank.functions.columns import safe_div
from pitrank.operators.factors import HIGHER, factor
from pitrank.operators.ranking import RankingSpec, rank_stocks
from pitrank.schemas import BENCHMARKS, FUNDAMENTALS, RETURNS

from .common import present, register, sql
from .core import BASE, FACTOR_SQL, SNAP_SQL, _values, form_sql, rank_sum_sql, universe_sql, values_sql
from .panel import BENCH_SQL, FUND_SQL, RET_SQL, panel, table


@factor("cash_to_assets", "cash held", "cash / total assets", HIGHER, ["cash", "total_assets"], "NULL without positive assets",
        category="Safety")
def cash_to_assets():
    return safe_div("cash", "total_assets")


FACTOR_SQL["cash_to_assets"] = ("cash", "total_assets")
OWN = {"cash_to_assets": 1.0, "earnings_yield": 3.0}
OWN_LAYOUT = "formation_date:d security_id cash_to_assets_rank:1 earnings_yield_rank:1 score:6 score_raw:6 rank:i"


@register("x14_registered_factor", sql(OWN_LAYOUT, "ranked", *BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(OWN),
                                       rank_sum_sql(OWN)))
def x14(spark, sf):
    """A factor registered outside the library ranks next to a built-in one."""
    return present(rank_stocks(_values(spark, sf, list(OWN)), RankingSpec(OWN)), OWN_LAYOUT)


PROBLEM_LAYOUT = "table_name n_rows:i problem"


@register("q01_schema_problems", sql(PROBLEM_LAYOUT, "y", RET_SQL, FUND_SQL, BENCH_SQL, """
counts AS (SELECT 'returns' AS table_name, count(*) AS n_rows FROM ret UNION ALL SELECT 'fundamentals', count(*) FROM fund
           UNION ALL SELECT 'benchmarks', count(*) FROM bench),
y AS (SELECT c.*, p.problem FROM counts c JOIN (VALUES ('returns', 'price: string instead of double'),
        ('returns', 'exchange: missing'), ('fundamentals', NULL), ('benchmarks', 'risk_free_rate: missing')) p(table_name, problem)
      USING (table_name))"""))
def q01(spark, sf):
    """The canonical tables with a column dropped and one of another type, next to their number of rows."""
    p = panel(spark, sf)
    odd = {"returns": (p.returns.drop("exchange").withColumn("price", F.col("price").cast("string")), RETURNS),
           "fundamentals": (p.fundamentals, FUNDAMENTALS), "benchmarks": (p.benchmarks.drop("risk_free_rate"), BENCHMARKS)}
    found = [(name, x) for name, (df, schema) in odd.items() for x in schema_problems(df, schema) or [None]]
    listed = spark.createDataFrame(found, "table_name string, problem string")
    return present(contract_counts(p).join(listed, "table_name"), PROBLEM_LAYOUT)


WANTED = {"lineitem": ["l_orderkey", "L_ShipDate", "l_currency"], "orders": ["o_orderkey", "o_orderdate"], "filings": ["cik"]}
FOUND_LAYOUT = "table_name column_name expected found note n_rows:i"


@register("q09_expected_columns", sql(FOUND_LAYOUT, "y", """
wanted AS (SELECT * FROM (VALUES ('lineitem', 'l_orderkey'), ('lineitem', 'L_ShipDate'), ('lineitem', 'l_currency'),
                                 ('orders', 'o_orderkey'), ('orders', 'o_orderdate')) v(table_name, column_name)),
have AS (SELECT 'lineitem' AS table_name, lower(column_name) AS c FROM (DESCRIBE SELECT * FROM lineitem)
         UNION ALL SELECT 'orders', lower(column_name) FROM (DESCRIBE SELECT * FROM orders)),
counts AS (SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders),
listed AS (SELECT table_name, column_name, true AS expected, (table_name, lower(column_name)) IN (SELECT (table_name, c) FROM have) AS found,
                  '' AS note FROM wanted
           UNION ALL SELECT table_name, '(others)', false, true, string_agg(c, ', ' ORDER BY c) FROM have
           WHERE (table_name, c) NOT IN (SELECT (table_name, lower(column_name)) FROM wanted) GROUP BY table_name
           UNION ALL SELECT 'filings', '*', true, false, 'table not found'),
y AS (SELECT l.*, n_rows FROM listed l LEFT JOIN counts USING (table_name))"""))
def q09(spark, sf):
    """Which declared columns the given tables have, which others they have, and how many rows there are."""
    tables = {name: table(spark, sf, name) for name in ("lineitem", "orders")}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
                                            for name, df in tables.items()])
    return present(expected_columns(spark, tables, WANTED).join(counts, "table_name", "left"), FOUND_LAYOUT)
