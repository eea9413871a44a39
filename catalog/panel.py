"""The driver's order tables seen as a market: a supplier is a security, its shipments of a month a price bar.

Only used to give the operators realistic canonical tables whose size grows with the input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pitrank.functions.columns import month_end_at, month_index
from pitrank.functions.lineage import materialize_all
from pitrank.schemas import FUNDAMENTAL_VALUES
from pitrank.sources.canonical import Panel
from pitrank.vendor.market import panel_benchmarks

DAMPING = 0.1
RISK_FREE = 0.002
TOP_K = 25


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def security_id(k) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(k.cast("string"), 9, "0"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier and month: average price paid per unit."""
    li = table(spark, sf, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("sk"), month_index(F.to_date("l_shipdate")).alias("m"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity") * 0.9137261).alias("px")))


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly returns. One supplier in seven stops early; its last row is flagged and half of those lose 60 %."""
    b = bars(spark, sf)
    cut = F.lit(1998 * 12) + F.pmod("sk", F.lit(30))
    b = b.where((F.pmod("sk", F.lit(7)) != 3) | (F.col("m") <= cut))
    per = Window.partitionBy("sk").orderBy("m")
    b = (b.withColumn("prev", F.lag("px").over(per))
         .withColumn("last_m", F.max("m").over(Window.partitionBy("sk")))
         .where(F.col("prev").isNotNull()))
    dead = (F.pmod("sk", F.lit(7)) == 3) & (F.col("m") == F.col("last_m"))
    shares = F.lit(1e5) * (1 + F.pmod("sk", F.lit(50)))
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk"), "s_nationkey")
    exchange = F.get(F.array(*[F.lit(x) for x in ("AMEX", "OTC", "NYSE", "NYSE", "NASDAQ")]),
                     F.pmod("s_nationkey", F.lit(5)))
    return (b.join(nation, "sk", "left")
            .select(security_id(F.col("sk")).alias("security_id"), month_end_at("m").alias("date"),
                    F.when(dead & (F.pmod("sk", F.lit(14)) == 3), F.lit(-0.6))
                    .otherwise(DAMPING * (F.col("px") / F.col("prev") - 1)).alias("total_return"),
                    F.col("px").alias("price"), shares.alias("shares_outstanding"),
                    (F.col("px") * shares).alias("market_cap"), exchange.alias("exchange"),
                    (1000 + F.pmod(F.col("sk") * 379, F.lit(8000))).cast("long").alias("sic_code"),
                    dead.alias("is_delisted_this_month")))


RET_SQL = """
bars AS (SELECT l_suppkey AS sk, year(l_shipdate) * 12 + month(l_shipdate) AS m,
                sum(l_extendedprice) / sum(l_quantity) * 0.9137261::DOUBLE AS px
         FROM lineitem GROUP BY ALL),
kept AS (SELECT *, lag(px) OVER (PARTITION BY sk ORDER BY m) AS prev, max(m) OVER (PARTITION BY sk) AS last_m
         FROM bars WHERE sk % 7 <> 3 OR m <= 1998 * 12 + sk % 30),
ret AS (SELECT 'S' || lpad(CAST(sk AS VARCHAR), 9, '0') AS security_id,
               last_day(make_date(CAST((m - 1) // 12 AS BIGINT), CAST((m - 1) % 12 + 1 AS BIGINT), 1::BIGINT)) AS date,
               CASE WHEN sk % 14 = 3 AND m = last_m THEN -0.6::DOUBLE ELSE 0.1::DOUBLE * (px / prev - 1) END AS total_return,
               px AS price, 1e5::DOUBLE * (1 + sk % 50) AS shares_outstanding, px * (1e5::DOUBLE * (1 + sk % 50)) AS market_cap,
               CASE s_nationkey % 5 WHEN 0 THEN 'AMEX' WHEN 1 THEN 'OTC' WHEN 4 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange,
               1000 + (sk * 379) % 8000 AS sic_code, sk % 7 = 3 AND m = last_m AS is_delisted_this_month
        FROM kept LEFT JOIN supplier ON s_suppkey = sk WHERE prev IS NOT NULL)"""


def quarters(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly revenue and its four-quarter sum per supplier; sk, q (year*4+quarter), fpe, rev_q, rev."""
    li = table(spark, sf, "lineitem")
    d = F.to_date("l_shipdate")
    q = (li.groupBy(F.col("l_suppkey").alias("sk"), (F.year(d) * 4 + F.quarter(d)).alias("q"))
         .agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 13.5335283).alias("rev_q")))
    four = Window.partitionBy("sk").orderBy("q").rangeBetween(-3, 0)
    fpe = month_end_at(F.floor((F.col("q") - 1) / 4).cast("int") * 12 + (F.pmod(F.col("q") - 1, F.lit(4)) + 1) * 3)
    return (q.withColumn("rev", F.when(F.count("rev_q").over(four) == 4, F.sum("rev_q").over(four)))
            .withColumn("fpe", fpe))


# Accounting items as fixed fractions of revenue that depend on the key; the same text is valid in both SQL dialects.
ITEMS = {
    "ebit_ttm": "rev * (0.02 * (sk % 9) - 0.03 + 0.01 * (q % 3))",
    "revenue_ttm": "rev",
    "gross_profit_ttm": "CASE WHEN sk % 17 <> 5 THEN rev * (0.2 + 0.05 * (sk % 6)) + rev_q * 0.11 END",
    "net_income_ttm": "rev * (0.02 * (sk % 9) - 0.03 + 0.01 * (q % 3)) * 0.7 - rev * 0.01",
    "operating_cash_flow_ttm": "rev * (0.02 * (sk % 9) - 0.03 + 0.01 * (q % 3)) * 0.8 + rev * 0.02",
    "capex_ttm": "rev * 0.03 * (1 + sk % 3)",
    "dividends_ttm": "rev * 0.01 * (sk % 4)",
    "current_assets": "rev * (0.3 + 0.02 * (sk % 7))",
    "cash": "rev * 0.05 * (1 + sk % 3)",
    "current_liabilities": "rev * (0.15 + 0.02 * (sk % 10))",
    "short_term_debt": "rev * 0.03 * (sk % 4)",
    "long_term_debt": "rev * 0.1 * (sk % 6)",
    "net_ppe": "CASE WHEN sk % 19 <> 7 THEN rev * (0.2 + 0.05 * (sk % 8)) + rev_q * 0.17 END",
    "total_assets": "rev * (1.0 + 0.1 * (sk % 9)) + rev_q * 0.23",
    "book_equity": "rev * (0.35 - 0.1 * (sk % 6)) + rev_q * 0.07",
    "preferred_stock": "CASE WHEN sk % 10 = 0 THEN rev * 0.02 ELSE 0 END",
    "minority_interest": "CASE WHEN sk % 12 = 0 THEN rev * 0.01 ELSE 0 END",
    "shares_diluted": "100000.0 * (1 + sk % 50) * (1.02 + 0.005 * (q % 5))",
}


def _as_double(text: str) -> str:
    """Decimal literals as doubles, so neither engine computes with exact decimals."""
    import re
    return re.sub(r"(?<![\w.])(\d+\.\d+)", r"CAST(\1 AS DOUBLE)", text)


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Filings 45 to 89 days after the period; one quarter in 23 never filed, one filing in eleven restated later."""
    q = quarters(spark, sf).where("rev IS NOT NULL AND (sk * 31 + q) % 23 <> 0")
    base = q.select("sk", "q", security_id(F.col("sk")).alias("security_id"), F.col("fpe").alias("fiscal_period_end"),
                    F.expr("date_add(fpe, CAST(45 + sk % 45 AS INT))").alias("available_date"),
                    *[F.expr(_as_double(x)).cast("double").alias(c) for c, x in ITEMS.items()])
    scale = {"ebit_ttm": 0.9, "net_income_ttm": 0.9, "revenue_ttm": 1.02}
    again = F.when(F.expr("(sk + q) % 11 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = base.withColumn("_v", F.explode(again))
    second = F.col("_v") == 1
    return out.select(
        "security_id", "fiscal_period_end",
        F.when(second, F.expr("date_add(available_date, CAST(90 + sk % 60 AS INT))")).otherwise(F.col("available_date"))
        .alias("available_date"),
        *[(F.when(second, F.col(c) * scale[c]).otherwise(F.col(c)).alias(c) if c in scale else F.col(c))
          for c in FUNDAMENTAL_VALUES])


FUND_SQL = f"""
qrev AS (SELECT l_suppkey AS sk, year(l_shipdate) * 4 + quarter(l_shipdate) AS q,
                sum(l_extendedprice * (1 - l_discount)) * 13.5335283::DOUBLE AS rev_q
         FROM lineitem GROUP BY ALL),
qttm AS (SELECT a.sk, a.q, a.rev_q,
                last_day(make_date(CAST((a.q - 1) // 4 AS BIGINT), CAST(((a.q - 1) % 4 + 1) * 3 AS BIGINT), 1::BIGINT)) AS fpe,
                CASE WHEN count(b.rev_q) = 4 THEN sum(b.rev_q) END AS rev
         FROM qrev a JOIN qrev b ON a.sk = b.sk AND b.q BETWEEN a.q - 3 AND a.q GROUP BY a.sk, a.q, a.rev_q),
filed AS (SELECT sk, q, 'S' || lpad(CAST(sk AS VARCHAR), 9, '0') AS security_id, fpe AS fiscal_period_end,
                 fpe + CAST(45 + sk % 45 AS INTEGER) AS available_date,
                 {', '.join(f'CAST({_as_double(x)} AS DOUBLE) AS {c}' for c, x in ITEMS.items())}
          FROM qttm WHERE rev IS NOT NULL AND (sk * 31 + q) % 23 <> 0),
fund AS (SELECT * EXCLUDE (sk, q) FROM filed
         UNION ALL
         SELECT * EXCLUDE (sk, q) REPLACE (available_date + CAST(90 + sk % 60 AS INTEGER) AS available_date,
                  ebit_ttm * 0.9::DOUBLE AS ebit_ttm, net_income_ttm * 0.9::DOUBLE AS net_income_ttm,
                  revenue_ttm * 1.02::DOUBLE AS revenue_ttm)
         FROM filed WHERE (sk + q) % 11 = 0)"""

BENCH_SQL = f"""
lagged AS (SELECT r.security_id, r.date, r.total_return, p.market_cap AS cap0
           FROM ret r LEFT JOIN ret p ON p.security_id = r.security_id AND last_day(p.date + INTERVAL 1 DAY) = r.date),
largest AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cap0 DESC, security_id) AS pos
            FROM lagged WHERE cap0 IS NOT NULL),
topk AS (SELECT date, sum(cap0 * total_return) / sum(cap0) AS sp FROM largest WHERE pos <= {TOP_K} GROUP BY date),
bench AS (SELECT l.date, any_value(sp) AS sp500_total_return,
                 sum(cap0 * total_return) / sum(CASE WHEN total_return IS NOT NULL THEN cap0 END) AS market_vw_return,
                 avg(total_return) AS market_ew_return, {RISK_FREE}::DOUBLE AS risk_free_rate
          FROM lagged l LEFT JOIN topk USING (date) GROUP BY l.date)"""

PANEL_SQL = ",".join([RET_SQL, FUND_SQL, BENCH_SQL])


def panel(spark: SparkSession, sf: str, filings: bool = True) -> Panel:
    """The canonical tables, landed once: monthly bars are far smaller than the order lines they come from.

    Without ``filings`` the accounting table stays a plan: for queries that read it once or not at all.
    """
    f = fundamentals(spark, sf)
    r, *landed = materialize_all(returns(spark, sf), *([f] if filings else []))
    return Panel(r, landed[0] if filings else f, panel_benchmarks(r, TOP_K, RISK_FREE))
