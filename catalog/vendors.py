"""Vendor-shaped inputs derived from the order tables, and the transforms that turn them into canonical tables."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from pitrank.functions.lineage import materialize
from pitrank.plans.backtest import run_backtest
from pitrank.sources.bars import price_bars
from pitrank.vendor import accounting as A
from pitrank.vendor import equity as E
from pitrank.vendor import facts as X
from pitrank.vendor.market import proxy_benchmarks, returns_from_prices, shares_asof
from pitrank.vendor.panels import StockFiles, panel_from_filings, panel_from_stock_files

from .common import ORACLES, present, register, sql
from .core import SPEC
from .panel import PANEL_SQL, RET_SQL, bars, quarters, returns, table
from .portfolios import MONTHLY_LAYOUT

S, T = "1996-01-31", "2001-06-30"


def ex(text: str):
    return F.expr(text)


# ================================================================= stock files
def msf(spark, sf):
    per = Window.partitionBy("sk").orderBy("m")
    return (bars(spark, sf).withColumn("prev", F.lag("px").over(per)).select(
        F.col("sk").alias("permno"), ex("date_add(make_date(CAST(floor((m - 1) / 12) AS INT), pmod(m - 1, 12) + 1, 1), CAST(20 + sk % 7 AS INT))").alias("date"),
        ex("CASE WHEN (sk + m) % 37 <> 0 THEN 0.1D * (px / prev - 1) END").alias("ret"),
        ex("CASE WHEN (sk + m) % 9 = 0 THEN -px ELSE px END").alias("prc"), ex("CAST(100 * (1 + sk % 50) AS DOUBLE)").alias("shrout")))


MSF_SQL = """
b0 AS (SELECT l_suppkey AS sk, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(l_extendedprice) / sum(l_quantity) * 0.9137261::DOUBLE AS px FROM lineitem GROUP BY ALL),
b1 AS (SELECT *, lag(px) OVER (PARTITION BY sk ORDER BY m) AS prev FROM b0),
msf AS (SELECT sk AS permno, make_date((m - 1) // 12, (m - 1) % 12 + 1, 1) + CAST(20 + sk % 7 AS INTEGER) AS date,
               CASE WHEN (sk + m) % 37 <> 0 THEN 0.1::DOUBLE * (px / prev - 1) END AS ret,
               CASE WHEN (sk + m) % 9 = 0 THEN -px ELSE px END AS prc, CAST(100 * (1 + sk % 50) AS DOUBLE) AS shrout FROM b1)"""


def names(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk"))
    first = s.select(F.col("sk").alias("permno"), F.lit("1990-01-01").cast("date").alias("namedt"), F.lit("1998-06-30").cast("date").alias("nameendt"),
                     ex("CAST(10 + sk % 4 AS INT)").alias("shrcd"), ex("CAST(1 + sk % 4 AS INT)").alias("exchcd"),
                     ex("CASE WHEN sk % 8 <> 0 THEN 1000 + sk * 379 % 8000 END").alias("siccd"))
    second = s.select(F.col("sk").alias("permno"), F.lit("1998-07-01").cast("date").alias("namedt"), F.lit(None).cast("date").alias("nameendt"),
                      ex("CAST(10 + sk % 3 AS INT)").alias("shrcd"), ex("CAST(1 + sk % 4 AS INT)").alias("exchcd"),
                      ex("2000 + sk * 379 % 8000").alias("siccd"))
    return first.unionByName(second)


NAMES_SQL = """
names AS (SELECT s_suppkey AS permno, DATE '1990-01-01' AS namedt, DATE '1998-06-30' AS nameendt, 10 + s_suppkey % 4 AS shrcd, 1 + s_suppkey % 4 AS exchcd,
                 CASE WHEN s_suppkey % 8 <> 0 THEN 1000 + s_suppkey * 379 % 8000 END AS siccd FROM supplier
          UNION ALL SELECT s_suppkey, DATE '1998-07-01', NULL, 10 + s_suppkey % 3, 1 + s_suppkey % 4, 2000 + s_suppkey * 379 % 8000 FROM supplier)"""


def delist(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk")).where("sk % 7 = 3")
    twice = s.withColumn("k", F.explode(ex("CASE WHEN sk % 14 = 3 THEN array(0, 1) ELSE array(0) END")))
    return twice.select(
        F.col("sk").alias("permno"), ex("make_date(CAST(1998 + floor((sk % 30) / 12) - k AS INT), CAST(sk % 12 + 1 AS INT), 15)").alias("dlstdt"),
        ex("CASE WHEN sk % 3 <> 0 THEN -0.25D END").alias("dlret"), ex("CAST(500 + sk % 100 AS INT)").alias("dlstcd"))


DELIST_SQL = """
delist AS (SELECT s_suppkey AS permno, make_date(CAST(1998 + (s_suppkey % 30) // 12 - k AS BIGINT), CAST(s_suppkey % 12 + 1 AS BIGINT), 15::BIGINT) AS dlstdt,
                  CASE WHEN s_suppkey % 3 <> 0 THEN -0.25::DOUBLE END AS dlret, 500 + s_suppkey % 100 AS dlstcd
           FROM supplier, range(2) t(k) WHERE s_suppkey % 7 = 3 AND (k = 0 OR s_suppkey % 14 = 3))"""
SCAN_SQL = f"""
scan AS (SELECT a.*, b.shrcd, b.exchcd, b.siccd FROM msf a JOIN names b ON a.permno = b.permno AND a.date >= b.namedt
              AND a.date <= coalesce(b.nameendt, DATE '2099-12-31')
         WHERE a.date BETWEEN DATE '{S}' AND DATE '{T}' AND shrcd IN (10, 11) AND exchcd IN (1, 2, 3))"""
SCAN_LAYOUT = "permno:i date:d ret:9 prc:6 shrout:2 shrcd:i exchcd:i siccd:1"


@register("s05_legacy_stock_scan", sql(SCAN_LAYOUT, "scan", MSF_SQL, NAMES_SQL, SCAN_SQL))
def s05(spark, sf):
    return present(E.legacy_stock_scan(msf(spark, sf), names(spark, sf), S, T), SCAN_LAYOUT)


@register("s06_legacy_delistings", sql("permno:i dlstdt:d dlret:4 dlstcd:i", "delist", DELIST_SQL))
def s06(spark, sf):
    return present(E.legacy_delistings(delist(spark, sf)), "permno:i dlstdt:d dlret:4 dlstcd:i")


COMPOUND_SQL = """
lat AS (SELECT permno, last_day(dlstdt) AS date, coalesce(dlret, CASE WHEN dlstcd = 500 OR dlstcd BETWEEN 520 AND 584 THEN -0.3::DOUBLE ELSE 0 END) AS dl
        FROM delist WHERE permno IN (SELECT permno FROM scan) QUALIFY row_number() OVER (PARTITION BY permno ORDER BY dlstdt DESC) = 1),
comp AS (SELECT coalesce(a.permno, d.permno) AS permno, coalesce(last_day(a.date), d.date) AS date,
                CASE WHEN a.permno IS NULL THEN d.dl WHEN d.permno IS NOT NULL THEN (1 + coalesce(ret, 0)) * (1 + dl) - 1 ELSE ret END AS ret,
                prc, shrout, exchcd, siccd, d.permno IS NOT NULL AS is_delisted_this_month
         FROM scan a FULL JOIN lat d ON a.permno = d.permno AND last_day(a.date) = d.date
         WHERE NOT EXISTS (SELECT 1 FROM lat z WHERE z.permno = coalesce(a.permno, d.permno) AND last_day(a.date) > z.date))"""
COMP_LAYOUT = "permno:i date:d ret:9 prc:6 is_delisted_this_month"


def _compounded(spark, sf):
    return E.compound_delistings(E.legacy_stock_scan(msf(spark, sf), names(spark, sf), S, T), delist(spark, sf))


@register("v02_compound_delistings", sql(COMP_LAYOUT, "comp", MSF_SQL, NAMES_SQL, SCAN_SQL, DELIST_SQL, COMPOUND_SQL))
def v02(spark, sf):
    return present(_compounded(spark, sf), COMP_LAYOUT)


RET_LAYOUT = ("security_id date:d total_return:9 price:6 shares_outstanding:1 market_cap:0 exchange sic_code:i is_delisted_this_month")


@register("v01_v03_legacy_returns", sql(RET_LAYOUT, "y", MSF_SQL, NAMES_SQL, SCAN_SQL, DELIST_SQL, COMPOUND_SQL, """
y AS (SELECT CAST(permno AS VARCHAR) AS security_id, date, ret AS total_return, abs(prc) AS price, shrout * 1000 AS shares_outstanding,
             abs(prc) * (shrout * 1000) AS market_cap, CASE exchcd WHEN 1 THEN 'NYSE' WHEN 2 THEN 'AMEX' WHEN 3 THEN 'NASDAQ' ELSE 'OTHER' END AS exchange,
             coalesce(siccd, 0) AS sic_code, is_delisted_this_month FROM comp WHERE ret IS NOT NULL)"""))
def v03(spark, sf):
    return present(E.legacy_to_returns(_compounded(spark, sf)), RET_LAYOUT)


FLAGS = {"sharetype": "CASE WHEN permno % 13 = 0 THEN 'AD' ELSE 'NS' END", "securitytype": "CASE WHEN permno % 17 = 0 THEN 'FUND' ELSE 'EQTY' END",
         "securitysubtype": "CASE WHEN permno % 19 = 0 THEN 'PFD' ELSE 'COM' END", "usincflg": "CASE WHEN permno % 23 = 0 THEN 'N' ELSE 'Y' END",
         "issuertype": "CASE WHEN permno % 3 = 0 THEN 'CORP' WHEN permno % 29 = 0 THEN 'REIT' ELSE 'ACOR' END",
         "primaryexch": "CASE permno % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'Q' WHEN 3 THEN 'X' ELSE 'N' END",
         "conditionaltype": "CASE WHEN permno % 31 = 0 THEN 'WI' ELSE 'RW' END", "tradingstatusflg": "CASE WHEN permno % 37 = 1 THEN 'S' ELSE 'A' END",
         "siccd": "CASE WHEN permno % 8 <> 0 THEN 1000 + permno * 379 % 8000 END"}


def msf2(spark, sf):
    return msf(spark, sf).withColumnsRenamed({"date": "mthcaldt", "ret": "mthret", "prc": "mthprc"}).withColumns(
        {k: ex(v) for k, v in FLAGS.items()})


def stkdelists(spark, sf):
    return delist(spark, sf).select("permno", F.col("dlstdt").alias("delistingdt"), F.col("dlret").alias("delret"),
                                    F.col("dlstcd").alias("delreasontype"))


MSF2_SQL = ("\nmsf2 AS (SELECT permno, date AS mthcaldt, ret AS mthret, prc AS mthprc, shrout, "
            + ", ".join(f"{v} AS {k}" for k, v in FLAGS.items()) + f""" FROM msf),
ciz AS (SELECT permno, mthcaldt, mthret, mthprc, shrout, primaryexch, siccd FROM msf2 WHERE mthcaldt BETWEEN DATE '{S}' AND DATE '{T}'
        AND sharetype = 'NS' AND securitytype = 'EQTY' AND securitysubtype = 'COM' AND usincflg = 'Y' AND issuertype IN ('ACOR', 'CORP')
        AND primaryexch IN ('N', 'A', 'Q') AND conditionaltype = 'RW' AND tradingstatusflg = 'A')""")
CIZ_LAYOUT = "permno:i mthcaldt:d mthret:9 mthprc:6 shrout:1 primaryexch siccd:1"


@register("s07_new_stock_scan", sql(CIZ_LAYOUT, "ciz", MSF_SQL, MSF2_SQL))
def s07(spark, sf):
    return present(E.ciz_stock_scan(msf2(spark, sf), S, T), CIZ_LAYOUT)


@register("s08_new_delistings", sql("permno:i delistingdt:d delret:4 delreasontype:i", "y", DELIST_SQL,
          "y AS (SELECT permno, dlstdt AS delistingdt, dlret AS delret, dlstcd AS delreasontype FROM delist)"))
def s08(spark, sf):
    return present(E.ciz_delistings(stkdelists(spark, sf)), "permno:i delistingdt:d delret:4 delreasontype:i")


@register("v04_new_layout_returns", sql(RET_LAYOUT, "y", MSF_SQL, MSF2_SQL, DELIST_SQL, """
y AS (SELECT CAST(permno AS VARCHAR) AS security_id, last_day(mthcaldt) AS date, mthret AS total_return, abs(mthprc) AS price,
             shrout * 1000 AS shares_outstanding, abs(mthprc) * (shrout * 1000) AS market_cap,
             CASE primaryexch WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'AMEX' WHEN 'Q' THEN 'NASDAQ' ELSE 'OTHER' END AS exchange, coalesce(siccd, 0) AS sic_code,
             EXISTS (SELECT 1 FROM delist d WHERE d.permno = c.permno AND last_day(d.dlstdt) = last_day(c.mthcaldt)) AS is_delisted_this_month
      FROM ciz c WHERE mthret IS NOT NULL)"""))
def v04(spark, sf):
    return present(E.ciz_to_returns(E.ciz_stock_scan(msf2(spark, sf), S, T), E.ciz_delistings(stkdelists(spark, sf))), RET_LAYOUT)


def market_tables(spark, sf):
    r = returns(spark, sf).groupBy("date").agg(F.avg("total_return").alias("ewretd"), F.max("total_return").alias("hi"), F.min("total_return").alias("lo"))
    first = F.date_trunc("month", "date").cast("date")
    return (r.select(F.date_sub("date", 1).alias("date"), F.col("ewretd").alias("vwretd"), (F.col("ewretd") + 0.001).alias("ewretd")),
            r.where("month(date) <> 5").select(F.col("date").alias("caldt"), ((F.col("hi") + F.col("lo")) / 2).alias("vwretd")),
            r.select(first.alias("date"), (F.month("date") / 10000).alias("rf")))


BENCH_LAYOUT = "date:d sp500_total_return:9 market_vw_return:9 market_ew_return:9 risk_free_rate:9"


@register("s12_v13_index_benchmarks", sql(BENCH_LAYOUT, "y", RET_SQL, f"""
mm AS (SELECT date, avg(total_return) AS e, max(total_return) AS hi, min(total_return) AS lo FROM ret GROUP BY date),
y AS (SELECT date, e AS market_vw_return, e + 0.001 AS market_ew_return, CASE WHEN month(date) <> 5 THEN (hi + lo) / 2 END AS sp500_total_return,
             month(date) / 10000.0::DOUBLE AS risk_free_rate FROM mm WHERE date - 1 BETWEEN DATE '{S}' AND DATE '2001-07-15' AND date - 1 <= DATE '{T}')
""").replace("CASE WHEN month(date) <> 5 THEN (hi", f"CASE WHEN month(date) <> 5 AND date BETWEEN DATE '{S}' AND DATE '{T}' THEN (hi"))
def s12(spark, sf):
    return present(E.index_benchmarks(*market_tables(spark, sf), S, T), BENCH_LAYOUT)


# ================================================================= accounting files
FLOW_Q = {"saleq": "rev_q / 1e6", "cogsq": "rev_q * 0.6 / 1e6", "oiadpq": "rev_q * (0.02 * (sk % 9) - 0.03) / 1e6",
          "niq": "rev_q * 0.05 / 1e6", "oancfq_": "rev_q * 0.1 / 1e6", "capxq_": "rev_q * 0.03 / 1e6", "dvq_": "CASE WHEN (sk + q) % 19 <> 0 THEN rev_q * 0.01 / 1e6 END"}
STOCK_Q = {"actq": "0.3", "cheq": "0.05", "lctq": "0.15", "dlcq": "0.03", "dlttq": "0.4", "ppentq": "0.35", "atq": "1.4", "ceqq": "0.4",
           "pstkq": "0.01", "mibq": "0.02", "cshfdq": "0.001"}


def _sqlnum(text: str) -> str:
    import re
    return re.sub(r"(?<![\w.])(\d+\.\d+|1e6)", r"CAST(\1 AS DOUBLE)", text)


BASE_COLS = ["'G' || CAST(sk AS STRING) AS gvkey", "fpe AS datadate", "CAST(year(fpe) AS INT) AS fyearq", "CAST(quarter(fpe) AS INT) AS fqtr",
             "CASE sk % 5 WHEN 0 THEN NULL WHEN 1 THEN date_add(fpe, CAST(q % 7 * 10 - 15 AS INT)) ELSE date_add(fpe, CAST(30 + sk % 40 AS INT)) END AS rdq",
             "CASE WHEN sk % 20 = 19 THEN 'FS' ELSE 'INDL' END AS indfmt", "'STD' AS datafmt", "'D' AS popsrc", "'C' AS consol"]


def fundq(spark, sf):
    q = quarters(spark, sf).where("(sk * 31 + q) % 23 <> 0")
    cols = BASE_COLS + [f"{_sqlnum(v)} AS {k}" for k, v in FLOW_Q.items()] + [f"rev_q * {_sqlnum(v)} / CAST(1e6 AS DOUBLE) AS {k}" for k, v in STOCK_Q.items()]
    rows = q.selectExpr("sk", "q", *cols, "CASE WHEN sk % 4 <> 0 THEN rev_q * CAST(0.02 AS DOUBLE) / CAST(1e6 AS DOUBLE) END AS txditcq")
    ytd = Window.partitionBy("gvkey", "fyearq").orderBy("fqtr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"oancfy": F.sum("oancfq_").over(ytd), "capxy": F.sum("capxq_").over(ytd),
                             "dvy": F.when(F.col("dvq_").isNotNull(), F.sum("dvq_").over(ytd))})


FUNDQ_SQL = f"""
q0 AS (SELECT l_suppkey AS sk, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, sum(l_extendedprice * (1 - l_discount)) * 13.5335283::DOUBLE AS rev_q FROM lineitem GROUP BY ALL),
q1 AS (SELECT *, last_day(make_date(CAST((q - 1) // 4 AS BIGINT), CAST(((q - 1) % 4 + 1) * 3 AS BIGINT), 1::BIGINT)) AS fpe FROM q0 WHERE (sk * 31 + q) % 23 <> 0),
q2 AS (SELECT sk, q, {', '.join(c.replace('AS STRING', 'AS VARCHAR').replace('date_add(fpe, CAST(q % 7 * 10 - 15 AS INT))', 'fpe + CAST(q % 7 * 10 - 15 AS INTEGER)').replace('date_add(fpe, CAST(30 + sk % 40 AS INT))', 'fpe + CAST(30 + sk % 40 AS INTEGER)') for c in BASE_COLS)},
       {', '.join(f'{_sqlnum(v)} AS {k}' for k, v in FLOW_Q.items())}, {', '.join(f'rev_q * {_sqlnum(v)} / CAST(1e6 AS DOUBLE) AS {k}' for k, v in STOCK_Q.items())},
       CASE WHEN sk % 4 <> 0 THEN rev_q * CAST(0.02 AS DOUBLE) / CAST(1e6 AS DOUBLE) END AS txditcq FROM q1),
fundq AS (SELECT *, sum(oancfq_) OVER y AS oancfy, sum(capxq_) OVER y AS capxy, CASE WHEN dvq_ IS NOT NULL THEN sum(dvq_) OVER y END AS dvy
          FROM q2 WINDOW y AS (PARTITION BY gvkey, fyearq ORDER BY fqtr ROWS UNBOUNDED PRECEDING)),
fq AS (SELECT * FROM fundq WHERE indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C'
           AND datadate BETWEEN DATE '{S}' - INTERVAL 24 MONTH AND DATE '{T}')"""
FQ_LAYOUT = "gvkey datadate:d fyearq:i fqtr:i rdq:d saleq:8 cogsq:8 oancfy:8 capxy:8 dvy:8 atq:8 txditcq:8"


def _fq(spark, sf):
    return A.accounting_scan(fundq(spark, sf), A.QUARTERLY_COLUMNS, S, T)


@register("s09_quarterly_scan", sql(FQ_LAYOUT, "fq", FUNDQ_SQL))
def s09(spark, sf):
    return present(_fq(spark, sf), FQ_LAYOUT)


YTD_SQL = """
yq AS (SELECT a.*, a.oancfy - b.oancfy AS d1, a.capxy - b.capxy AS d2, a.dvy - b.dvy AS d3
       FROM fq a LEFT JOIN fq b ON a.gvkey = b.gvkey AND a.fyearq = b.fyearq AND b.fqtr = a.fqtr - 1),
qq AS (SELECT * EXCLUDE (d1, d2, d3), CASE WHEN fqtr = 1 THEN oancfy ELSE d1 END AS oancfq, CASE WHEN fqtr = 1 THEN capxy ELSE d2 END AS capxq,
              CASE WHEN fqtr = 1 THEN dvy ELSE d3 END AS dvq, saleq - cogsq AS gpq, ceqq + coalesce(txditcq, 0) AS beq FROM yq)"""
V05_LAYOUT = "gvkey fyearq:i fqtr:i oancfq:8 capxq:8 dvq:8"


@register("v05_ytd_to_quarter", sql(V05_LAYOUT, "qq", FUNDQ_SQL, YTD_SQL))
def v05(spark, sf):
    return present(A.ytd_to_quarterly(_fq(spark, sf)), V05_LAYOUT)


TTM_FLOWS = ["oiadpq", "saleq", "gpq", "niq", "oancfq", "capxq", "dvq"]
TTM_SQL = """
gp AS (SELECT *, datadate - lag(datadate) OVER (PARTITION BY gvkey ORDER BY datadate) AS gap, row_number() OVER (PARTITION BY gvkey ORDER BY datadate) AS rn FROM qq),
tt AS (SELECT a.gvkey, a.rn, min(b.gap) FILTER (b.rn > a.rn - 3) AS lo, max(b.gap) FILTER (b.rn > a.rn - 3) AS hi,
              count(b.gap) FILTER (b.rn > a.rn - 3) AS ng, """ + ", ".join(f"count(b.{c}) AS n_{c}, sum(b.{c}) AS s_{c}" for c in TTM_FLOWS) + """
       FROM gp a JOIN gp b ON a.gvkey = b.gvkey AND b.rn BETWEEN a.rn - 3 AND a.rn GROUP BY a.gvkey, a.rn),
ttm AS (SELECT gp.*, """ + ", ".join(f"CASE WHEN ng = 3 AND lo >= 80 AND hi <= 100 AND n_{c} = 4 THEN s_{c} END AS {c}_ttm" for c in TTM_FLOWS) + """
        FROM gp JOIN tt USING (gvkey, rn))"""
V06_LAYOUT = "gvkey datadate:d " + " ".join(f"{c}_ttm:8" for c in TTM_FLOWS)


@register("v06_ttm", sql(V06_LAYOUT, "ttm", FUNDQ_SQL, YTD_SQL, TTM_SQL))
def v06(spark, sf):
    f = A.ytd_to_quarterly(_fq(spark, sf)).withColumn("gpq", F.col("saleq") - F.col("cogsq"))
    return present(A.build_ttm(f, {c: c + "_ttm" for c in TTM_FLOWS}), V06_LAYOUT)


AVAIL_SQL = "CASE WHEN rdq IS NOT NULL AND rdq >= datadate THEN rdq ELSE datadate + 90 END"


@register("v07_availability", sql("gvkey datadate:d quarterly:d annual:d", "y", FUNDQ_SQL, f"""
y AS (SELECT gvkey, datadate, {AVAIL_SQL} AS quarterly, CAST(datadate + INTERVAL 4 MONTH AS DATE) AS annual FROM fq)"""))
def v07(spark, sf):
    return present(_fq(spark, sf).select("gvkey", "datadate", A.availability_date().alias("quarterly"),
                                         A.availability_date(annual=True).alias("annual")), "gvkey datadate:d quarterly:d annual:d")


def links(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sk"))
    k = s.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(3)]))).where("k = 0 OR (k = 1 AND sk % 3 = 0) OR (k = 2 AND sk % 4 = 1)")
    return k.selectExpr("'G' || CAST(sk AS STRING) AS gvkey", "CASE k WHEN 0 THEN sk WHEN 1 THEN sk + 1000000 ELSE sk + 2000000 END AS lpermno",
                        "CASE WHEN sk % 6 = 5 AND k = 0 THEN 'NU' WHEN sk % 2 = 0 THEN 'LU' ELSE 'LC' END AS linktype",
                        "CASE k WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'J' END AS linkprim",
                        "CASE k WHEN 0 THEN make_date(1997, 1, 1) ELSE make_date(1990, 1, 1) END AS linkdt",
                        "CASE WHEN k = 0 AND sk % 5 = 2 THEN make_date(1999, 12, 31) END AS linkenddt")


LINK_SQL = """
links AS (SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS gvkey, CASE k WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey + 1000000 ELSE s_suppkey + 2000000 END AS lpermno,
                 CASE WHEN s_suppkey % 6 = 5 AND k = 0 THEN 'NU' WHEN s_suppkey % 2 = 0 THEN 'LU' ELSE 'LC' END AS linktype,
                 CASE k WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'J' END AS linkprim, CASE k WHEN 0 THEN DATE '1997-01-01' ELSE DATE '1990-01-01' END AS linkdt,
                 CASE WHEN k = 0 AND s_suppkey % 5 = 2 THEN DATE '1999-12-31' END AS linkenddt
          FROM supplier, range(3) t(k) WHERE k = 0 OR (k = 1 AND s_suppkey % 3 = 0) OR (k = 2 AND s_suppkey % 4 = 1))"""
LINK_LAYOUT = "gvkey lpermno:i linktype linkprim linkdt:d linkenddt:d"


@register("s11_link_scan", sql(LINK_LAYOUT, "links", LINK_SQL))
def s11(spark, sf):
    return present(A.link_scan(links(spark, sf)), LINK_LAYOUT)


def linked_sql(src: str, name: str) -> str:
    return f"""
{name} AS (SELECT f.*, l.lpermno AS permno FROM {src} f JOIN links l ON f.gvkey = l.gvkey AND linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C')
              AND f.datadate >= l.linkdt AND f.datadate <= coalesce(l.linkenddt, DATE '2099-12-31')
           QUALIFY row_number() OVER (PARTITION BY f.gvkey, f.datadate ORDER BY linkprim = 'P' DESC, lpermno) = 1)"""


@register("v08_links", sql("gvkey datadate:d permno:i", "lk", FUNDQ_SQL, LINK_SQL, linked_sql("fq", "lk")))
def v08(spark, sf):
    return present(A.resolve_links(_fq(spark, sf), A.link_scan(links(spark, sf))), "gvkey datadate:d permno:i")


QCANON_SQL = ("\ntta AS (SELECT *, " + AVAIL_SQL + " AS available_date FROM ttm)," + linked_sql("tta", "ql") + ",\nqc AS (SELECT CAST(permno AS VARCHAR) AS security_id, "
              "datadate AS fiscal_period_end, available_date, " + ", ".join(f"{v} * 1e6::DOUBLE AS {k}" for k, v in A.QUARTERLY_ITEMS.items()) + " FROM ql)")
CANON_LAYOUT = "security_id fiscal_period_end:d available_date:d " + " ".join(f"{c}:1" for c in A.QUARTERLY_ITEMS)
QC = [FUNDQ_SQL, YTD_SQL, TTM_SQL, LINK_SQL, QCANON_SQL]


@register("v09_quarterly_to_canonical", sql(CANON_LAYOUT, "qc", *QC))
def v09(spark, sf):
    return present(A.quarterly_to_canonical(_fq(spark, sf), A.link_scan(links(spark, sf))), CANON_LAYOUT)


ANNUAL_FROM = {"sale": "saleq", "cogs": "cogsq", "oiadp": "oiadpq", "ni": "niq", "oancf": "oancfq_", "capx": "capxq_", "dvt": "dvq_"}
ANNUAL_STOCK = {"act": "actq", "che": "cheq", "lct": "lctq", "dlc": "dlcq", "dltt": "dlttq", "ppent": "ppentq", "at": "atq", "ceq": "ceqq", "pstk": "pstkq",
                "mib": "mibq", "txditc": "txditcq", "cshfd": "cshfdq"}


def funda(spark, sf):
    f = fundq(spark, sf)
    return f.groupBy("gvkey", "sk", F.col("fyearq").alias("fyear"), "indfmt", "datafmt", "popsrc", "consol").agg(
        F.max("datadate").alias("datadate"), *[(F.sum(v) * 1.01).alias(k) for k, v in ANNUAL_FROM.items()],
        *[F.max_by(v, "fqtr").alias(k) for k, v in ANNUAL_STOCK.items()]).where("fyear % 3 <> 0 OR sk % 2 = 0").withColumn(
        "datadate", ex("CASE WHEN sk % 3 = 1 THEN date_add(datadate, 31) ELSE datadate END"))


FUNDA_SQL = ("\nfunda AS (SELECT * REPLACE (CASE WHEN sk % 3 = 1 THEN datadate + 31 ELSE datadate END AS datadate) FROM (SELECT gvkey, sk, fyearq AS fyear, indfmt, datafmt, popsrc, consol, max(datadate) AS datadate, "
             + ", ".join(f"sum({v}) * 1.01::DOUBLE AS {k}" for k, v in ANNUAL_FROM.items()) + ", "
             + ", ".join(f"arg_max_null({v}, fqtr) AS {'at_' if k == 'at' else k}" for k, v in ANNUAL_STOCK.items())
             + f""" FROM fundq GROUP BY ALL) WHERE fyear % 3 <> 0 OR sk % 2 = 0),
fa AS (SELECT * FROM funda WHERE indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C' AND datadate BETWEEN DATE '{S}' - INTERVAL 24 MONTH AND DATE '{T}')""")
FA_LAYOUT = "gvkey datadate:d fyear:i sale:8 cogs:8 dvt:8 ceq:8 txditc:8"


@register("s10_annual_scan", sql(FA_LAYOUT, "fa", FUNDQ_SQL, FUNDA_SQL))
def s10(spark, sf):
    return present(A.accounting_scan(funda(spark, sf), A.ANNUAL_COLUMNS, S, T), FA_LAYOUT)


def _annual(spark, sf):
    return A.annual_to_canonical(A.accounting_scan(funda(spark, sf), A.ANNUAL_COLUMNS, S, T), A.link_scan(links(spark, sf)))


AC_EXPR = {**A.ANNUAL_ITEMS, "gross_profit_ttm": "(sale - cogs)", "book_equity": "(ceq + coalesce(txditc, 0))", "total_assets": "at_"}
ACANON_SQL = (linked_sql("fa", "al") + ",\nac AS (SELECT CAST(permno AS VARCHAR) AS security_id, datadate AS fiscal_period_end, "
              "CAST(datadate + INTERVAL 4 MONTH AS DATE) AS available_date, " + ", ".join(f"{v} * 1e6::DOUBLE AS {k}" for k, v in AC_EXPR.items()) + " FROM al)")


@register("v10_annual_to_canonical", sql(CANON_LAYOUT, "ac", FUNDQ_SQL, FUNDA_SQL, LINK_SQL, ACANON_SQL))
def v10(spark, sf):
    return present(_annual(spark, sf), CANON_LAYOUT)


MERGED_SQL = """
mg AS (SELECT * FROM qc UNION ALL SELECT * FROM ac WHERE NOT EXISTS
       (SELECT 1 FROM qc WHERE qc.security_id = ac.security_id AND qc.fiscal_period_end = ac.fiscal_period_end))"""


@register("v11_u02_quarterly_plus_annual", sql(CANON_LAYOUT, "mg", *QC, FUNDA_SQL, ACANON_SQL, MERGED_SQL))
def v11(spark, sf):
    q = A.quarterly_to_canonical(_fq(spark, sf), A.link_scan(links(spark, sf)))
    return present(A.merge_quarterly_annual(q, _annual(spark, sf)), CANON_LAYOUT)


@register("v12_finish_fundamentals", sql(CANON_LAYOUT, "y", *QC, FUNDA_SQL, ACANON_SQL, MERGED_SQL, """
y AS (SELECT * REPLACE (NULL::DOUBLE AS minority_interest) FROM mg WHERE security_id IS NOT NULL AND fiscal_period_end IS NOT NULL AND available_date IS NOT NULL)"""))
def v12(spark, sf):
    q = A.quarterly_to_canonical(_fq(spark, sf), A.link_scan(links(spark, sf)))
    merged = A.merge_quarterly_annual(q, _annual(spark, sf))
    return present(A.finish_fundamentals(merged.unionByName(merged).drop("minority_interest")), CANON_LAYOUT)


# ================================================================= nested documents
def fact_rows(spark, sf):
    """cik, taxonomy, tag, unit, position and the entry, one row per reported value."""
    q = quarters(spark, sf).where("(sk * 31 + q) % 23 <> 0")
    ytd = Window.partitionBy("sk", F.year("fpe")).orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.withColumn("ytd", F.sum("rev_q").over(ytd)).withColumn("nq", F.count("rev_q").over(ytd))
    durations = q.where("nq = quarter(fpe)").withColumn("tag", F.explode(ex(
        "CASE WHEN sk % 3 = 0 THEN array('Revenues', 'SalesRevenueNet', 'OperatingIncomeLoss') WHEN sk % 3 = 1 "
        "THEN array('SalesRevenueNet', 'CostOfRevenue', 'OperatingIncomeLoss') ELSE array('Revenues', 'GrossProfit', 'NetIncomeLoss') END")))
    factor = ("CASE tag WHEN 'Revenues' THEN 1.0D WHEN 'SalesRevenueNet' THEN 0.98D WHEN 'CostOfRevenue' THEN 0.6D WHEN 'GrossProfit' THEN 0.4D "
              "WHEN 'OperatingIncomeLoss' THEN 0.11D ELSE 0.07D END")
    dur = durations.selectExpr("sk AS cik", "'us-gaap' AS taxonomy", "tag", "'USD' AS unit", "make_date(year(fpe), 1, 1) AS start",
                               "date_sub(fpe, CAST((sk + q) % 4 AS INT)) AS end", f"ytd * {factor} AS val", "date_add(fpe, CAST(35 + sk % 50 AS INT)) AS filed")
    again = dur.where("cik % 5 = 0").selectExpr("cik", "taxonomy", "tag", "unit", "start", "end", "val * 1.5D AS val", "date_add(filed, 365) AS filed")
    inst = q.selectExpr("sk AS cik", "'us-gaap' AS taxonomy", "explode(array('Assets', 'StockholdersEquity', 'MinorityInterest')) AS tag",
                        "CASE WHEN sk % 7 = 0 THEN 'USD/shares' ELSE 'USD' END AS unit", "CAST(NULL AS DATE) AS start", "date_sub(fpe, CAST((sk + q) % 4 AS INT)) AS end",
                        "rev_q AS val", "date_add(fpe, CAST(40 + sk % 45 - CASE WHEN sk % 11 = 0 THEN 150 ELSE 0 END AS INT)) AS filed").where("NOT (tag = 'MinorityInterest' AND cik % 2 = 0)")
    shares = q.selectExpr("sk AS cik", "'dei' AS taxonomy", "'EntityCommonStockSharesOutstanding' AS tag", "'shares' AS unit", "CAST(NULL AS DATE) AS start",
                          "date_add(fpe, 20) AS end", "1000.0D * (1 + sk % 50) + q AS val", "date_add(fpe, 40) AS filed").where("cik % 9 <> 4")
    return dur.unionByName(again).unionByName(inst).unionByName(shares)


ROWS_SQL = """
q0 AS (SELECT l_suppkey AS sk, year(l_shipdate) * 4 + quarter(l_shipdate) AS q, sum(l_extendedprice * (1 - l_discount)) * 13.5335283::DOUBLE AS rev_q FROM lineitem GROUP BY ALL),
q1 AS (SELECT *, last_day(make_date(CAST((q - 1) // 4 AS BIGINT), CAST(((q - 1) % 4 + 1) * 3 AS BIGINT), 1::BIGINT)) AS fpe FROM q0 WHERE (sk * 31 + q) % 23 <> 0),
q2 AS (SELECT *, sum(rev_q) OVER w AS ytd, count(*) OVER w AS nq FROM q1 WINDOW w AS (PARTITION BY sk, year(fpe) ORDER BY q ROWS UNBOUNDED PRECEDING)),
du AS (SELECT sk AS cik, 'us-gaap' AS taxonomy, tag, 'USD' AS unit, make_date(year(fpe), 1, 1) AS "start", fpe - CAST((sk + q) % 4 AS INTEGER) AS "end",
              ytd * CASE tag WHEN 'Revenues' THEN 1.0 WHEN 'SalesRevenueNet' THEN 0.98 WHEN 'CostOfRevenue' THEN 0.6 WHEN 'GrossProfit' THEN 0.4
                     WHEN 'OperatingIncomeLoss' THEN 0.11 ELSE 0.07 END::DOUBLE AS val, fpe + CAST(35 + sk % 50 AS INTEGER) AS filed
       FROM (SELECT *, unnest(CASE sk % 3 WHEN 0 THEN ['Revenues', 'SalesRevenueNet', 'OperatingIncomeLoss'] WHEN 1 THEN ['SalesRevenueNet', 'CostOfRevenue', 'OperatingIncomeLoss']
                     ELSE ['Revenues', 'GrossProfit', 'NetIncomeLoss'] END) AS tag FROM q2 WHERE nq = quarter(fpe))),
ins AS (SELECT sk AS cik, 'us-gaap' AS taxonomy, tag, CASE WHEN sk % 7 = 0 THEN 'USD/shares' ELSE 'USD' END AS unit, NULL::DATE AS "start",
               fpe - CAST((sk + q) % 4 AS INTEGER) AS "end", rev_q AS val, fpe + CAST(40 + sk % 45 - CASE WHEN sk % 11 = 0 THEN 150 ELSE 0 END AS INTEGER) AS filed
        FROM q1, (VALUES ('Assets'), ('StockholdersEquity'), ('MinorityInterest')) v(tag) WHERE NOT (tag = 'MinorityInterest' AND sk % 2 = 0)),
shr AS (SELECT sk AS cik, 'dei' AS taxonomy, 'EntityCommonStockSharesOutstanding' AS tag, 'shares' AS unit, NULL::DATE AS "start", fpe + 20 AS "end",
               1000.0::DOUBLE * (1 + sk % 50) + q AS val, fpe + 40 AS filed FROM q1 WHERE sk % 9 <> 4),
facts AS (SELECT * FROM du UNION ALL SELECT * REPLACE (val * 1.5::DOUBLE AS val, filed + 365 AS filed) FROM du WHERE cik % 5 = 0
          UNION ALL SELECT * FROM ins UNION ALL SELECT * FROM shr)"""


def documents(spark, sf):
    """The rows packed into one nested document per company and tag, written as JSON text; junk values added."""
    e = fact_rows(spark, sf).withColumn("entry", F.struct(*[F.col(c).cast("string").alias(c) for c in ("start", "end", "val", "filed")]))
    per_tag = e.groupBy("cik", "taxonomy", "tag", "unit").agg(F.collect_list("entry").alias("entries"))
    junk = F.array(F.struct(*[F.lit(v).cast("string").alias(c) for c, v in
                             (("start", None), ("end", "2000-01-01"), ("val", "n/a"), ("filed", "2000-02-01"))]))
    units = F.create_map(F.lit("EUR"), junk, F.col("unit"), F.concat("entries", junk))
    facts = F.create_map("taxonomy", F.create_map("tag", F.struct(units.alias("units"))))
    return per_tag.select(F.to_json(F.struct("cik", facts.alias("facts"))).alias("document"))


def facts(spark, sf):
    return X.flatten_facts(X.parse_facts(documents(spark, sf)))


FACT_LAYOUT = "cik:i taxonomy tag unit start:d end:d val:2 filed:d"


def quoted(text: str) -> str:
    return text.replace("strftime(end,", 'strftime("end",').replace("AS end", 'AS "end"').replace("strftime(start,", 'strftime("start",').replace("AS start", 'AS "start"')


@register("s13_json_facts", quoted(sql(FACT_LAYOUT, "facts", ROWS_SQL)))
def s13(spark, sf):
    return present(facts(spark, sf), FACT_LAYOUT)


# Fixed values, written out for the SQL side: reporting tags per concept in order of priority.
TAGS = """
revenue: Revenues RevenueFromContractWithCustomerExcludingAssessedTax SalesRevenueNet RevenuesNetOfInterestExpense
cogs: CostOfRevenue CostOfGoodsAndServicesSold CostOfGoodsSold
gross_profit: GrossProfit
ebit: OperatingIncomeLoss
net_income: NetIncomeLoss ProfitLoss
ocf: NetCashProvidedByUsedInOperatingActivities NetCashProvidedByUsedInOperatingActivitiesContinuingOperations
capex: PaymentsToAcquirePropertyPlantAndEquipment PaymentsToAcquireProductiveAssets
dividends: PaymentsOfDividends PaymentsOfDividendsCommonStock PaymentsOfOrdinaryDividends
shares_diluted: WeightedAverageNumberOfDilutedSharesOutstanding
current_assets: AssetsCurrent
cash: CashAndCashEquivalentsAtCarryingValue CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents Cash
current_liabilities: LiabilitiesCurrent
short_term_debt: DebtCurrent LongTermDebtCurrent ShortTermBorrowings
long_term_debt: LongTermDebtNoncurrent LongTermDebt LongTermDebtAndCapitalLeaseObligations
net_ppe: PropertyPlantAndEquipmentNet
total_assets: Assets
book_equity: StockholdersEquity StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest
preferred_stock: PreferredStockValue
minority_interest: MinorityInterest
"""
CONCEPTS = {c: tags.split() for c, tags in (line.split(": ") for line in TAGS.strip().split("\n"))}


def concept_case(groups) -> str:
    rows = [f"('{t}', '{c}', {i})" for g in groups for c, tags in g.items() for i, t in enumerate(tags)]
    return "tags(tag, concept, priority) AS (VALUES " + ", ".join(rows) + ")"


CONCEPT_SQL = concept_case([CONCEPTS]) + """,
cv AS (SELECT cik, concept, "start", "end", val, filed FROM facts JOIN tags USING (tag) WHERE taxonomy = 'us-gaap'
       QUALIFY row_number() OVER (PARTITION BY cik, concept, "start", "end" ORDER BY priority, filed, val) = 1)"""
CV_LAYOUT = "cik:i concept start:d end:d val:2 filed:d"


@register("v14_concepts", quoted(sql(CV_LAYOUT, "cv", ROWS_SQL, CONCEPT_SQL)))
def v14(spark, sf):
    return present(X.concept_values(facts(spark, sf)), CV_LAYOUT)


@register("v15_first_reported", quoted(sql("cik:i tag end:d val:2 filed:d", "y", ROWS_SQL, """
y AS (SELECT cik, tag, "end", val, filed FROM facts QUALIFY row_number() OVER (PARTITION BY cik, tag, "end" ORDER BY filed, val) = 1)""")))
def v15(spark, sf):
    return present(X.first_reported(fact_rows(spark, sf), ["cik", "tag", "end"]), "cik:i tag end:d val:2 filed:d")


TTMD_SQL = """
dd AS (SELECT *, "end" - "start" AS days FROM cv WHERE "start" IS NOT NULL),
an AS (SELECT * FROM dd WHERE days BETWEEN 350 AND 380 QUALIFY row_number() OVER (PARTITION BY cik, concept, "end" ORDER BY filed) = 1),
yt AS (SELECT * FROM dd WHERE days BETWEEN 60 AND 300 QUALIFY row_number() OVER (PARTITION BY cik, concept, "end" ORDER BY days DESC) = 1),
cand AS (SELECT y.cik, y.concept, y."end", a.val + y.val - p.val AS ttm, greatest(y.filed, a.filed) AS filed, p.filed AS prior_filed,
                row_number() OVER (PARTITION BY y.cik, y.concept, y."end" ORDER BY a."end" DESC, p.filed, p."end") AS pick,
                y."end" - max(a."end") OVER (PARTITION BY y.cik, y.concept, y."end") AS age
         FROM yt y JOIN an a ON a.cik = y.cik AND a.concept = y.concept AND a."end" < y."end"
         JOIN yt p ON p.cik = y.cik AND p.concept = y.concept AND abs(p."end" - CAST(y."end" - INTERVAL 12 MONTH AS DATE)) <= 12 AND abs(p.days - y.days) <= 12),
tm AS (SELECT cik, concept, "end", val AS ttm, filed, NULL::DATE AS prior_filed FROM an
       UNION ALL SELECT cik, concept, "end", ttm, filed, prior_filed FROM cand c WHERE pick = 1 AND age <= 300
            AND NOT EXISTS (SELECT 1 FROM an WHERE an.cik = c.cik AND an.concept = c.concept AND an."end" = c."end"))"""
TTMD_LAYOUT = "cik:i concept end:d ttm:2 filed:d prior_filed:d"


@register("v16_ttm_durations", quoted(sql(TTMD_LAYOUT, "tm", ROWS_SQL, CONCEPT_SQL, TTMD_SQL)))
def v16(spark, sf):
    return present(X.ttm_from_durations(materialize(X.concept_values(facts(spark, sf)))), TTMD_LAYOUT)


@register("v16_late_prior_values", sql("concept n_interim:i n_late:i", "y", ROWS_SQL, CONCEPT_SQL, TTMD_SQL, """
y AS (SELECT concept, count(prior_filed) AS n_interim, count(*) FILTER (prior_filed > filed) AS n_late FROM tm GROUP BY concept)"""))
def v16_late(spark, sf):
    return present(X.late_prior_values(X.ttm_from_durations(materialize(X.concept_values(facts(spark, sf))))), "concept n_interim:i n_late:i")


@register("v17_instants", quoted(sql("cik:i concept end:d val:2 filed:d", "y", ROWS_SQL, CONCEPT_SQL, """y AS (SELECT * FROM cv WHERE "start" IS NULL)""")))
def v17(spark, sf):
    return present(X.instants(X.concept_values(facts(spark, sf))), "cik:i concept end:d val:2 filed:d")


CF_LAYOUT = ("security_id fiscal_period_end:d available_date:d revenue_ttm:2 gross_profit_ttm:2 ebit_ttm:2 net_income_ttm:2 total_assets:2 book_equity:2 "
             "minority_interest:2 preferred_stock:2 short_term_debt:2 long_term_debt:2 cash:2")


def _pick(concept, col):
    return f"max({col}) FILTER (concept = '{concept}')"


CF_SQL = f"""
al AS (SELECT cik, concept, "end", ttm AS x, filed FROM tm UNION ALL SELECT cik, concept, "end", val, filed FROM cv WHERE "start" IS NULL),
wd AS (SELECT cik, "end", {', '.join(_pick(c, 'x') + ' AS ' + c for c in CONCEPTS)},
              max(filed) FILTER (concept <> 'cogs') AS last_filed FROM al GROUP BY ALL),
gr AS (SELECT *, max((gross_profit IS NOT NULL)::INT) OVER (PARTITION BY cik) AS has_gross FROM wd),
cf AS (SELECT CAST(cik AS VARCHAR) AS security_id, "end" AS fiscal_period_end, CASE WHEN last_filed >= "end" THEN last_filed ELSE "end" + 45 END AS available_date,
              revenue AS revenue_ttm, CASE WHEN has_gross = 1 THEN gross_profit ELSE revenue - cogs END AS gross_profit_ttm, ebit AS ebit_ttm, net_income AS net_income_ttm,
              total_assets, book_equity, coalesce(minority_interest, 0) AS minority_interest, coalesce(preferred_stock, 0) AS preferred_stock,
              coalesce(short_term_debt, 0) AS short_term_debt, long_term_debt, cash
       FROM gr WHERE total_assets IS NOT NULL AND revenue IS NOT NULL)"""


@register("v18_company_fundamentals", sql(CF_LAYOUT, "cf", ROWS_SQL, CONCEPT_SQL, TTMD_SQL, CF_SQL))
def v18(spark, sf):
    return present(X.company_fundamentals(facts(spark, sf)), CF_LAYOUT)


UNDATED = ROWS_SQL.replace("facts AS (SELECT", "reported AS (SELECT") + """,
facts AS (SELECT * FROM reported WHERE NOT (dayofmonth(filed) % 3 = 1 AND cik % 2 = 0))"""


@register("v18_undated_facts", sql(CF_LAYOUT, "cf", UNDATED, CONCEPT_SQL, TTMD_SQL, CF_SQL))
def v18_undated(spark, sf):
    """Some reports of every second company have no readable filing date: they count for nothing."""
    lost = (F.pmod("cik", F.lit(2)) == 0) & (F.pmod(F.dayofmonth("filed"), F.lit(3)) == 1)
    return present(X.company_fundamentals(facts(spark, sf).withColumn("filed", F.when(~lost, F.col("filed")))), CF_LAYOUT)


@register("v18_undated_concepts", quoted(sql(CV_LAYOUT, "cv", UNDATED.replace(
    "SELECT * FROM reported WHERE NOT (dayofmonth(filed) % 3 = 1 AND cik % 2 = 0)",
    "SELECT * REPLACE (CASE WHEN NOT (dayofmonth(filed) % 3 = 1 AND cik % 2 = 0) THEN filed END AS filed) FROM reported"),
    CONCEPT_SQL.replace("ORDER BY priority, filed, val", "ORDER BY priority, filed NULLS LAST, val"))))
def v18_concepts(spark, sf):
    """A report without a filing date counts only where no dated one of the same tag is there."""
    lost = (F.pmod("cik", F.lit(2)) == 0) & (F.pmod(F.dayofmonth("filed"), F.lit(3)) == 1)
    return present(X.concept_values(facts(spark, sf).withColumn("filed", F.when(~lost, F.col("filed")))), CV_LAYOUT)


@register("v19_shares_history", quoted(sql("cik:i end:d val:2 filed:d", "shr", ROWS_SQL)))
def v19(spark, sf):
    return present(X.shares_history(facts(spark, sf)), "cik:i end:d val:2 filed:d")


SUB_LAYOUT = "cik:i sic_code:i exchange"


@register("s14_submissions", sql(SUB_LAYOUT, "y", """
y AS (SELECT s_suppkey AS cik, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 1000 + s_suppkey % 7000 END AS sic_code,
             CASE s_suppkey % 7 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'AMEX' WHEN 3 THEN 'OTHER' WHEN 4 THEN 'OTC' ELSE 'OTHER' END AS exchange
      FROM supplier)"""))
def s14(spark, sf):
    docs = table(spark, sf, "supplier").select(F.to_json(F.struct(
        F.col("s_suppkey").alias("cik"), ex("CASE WHEN s_suppkey % 6 <> 0 THEN CAST(1000 + s_suppkey % 7000 AS STRING) END").alias("sic"),
        ex("CASE s_suppkey % 7 WHEN 0 THEN array('Nasdaq', 'NYSE') WHEN 1 THEN array('NYSE') WHEN 2 THEN array('NYSE American') WHEN 3 THEN array('CBOE') "
           "WHEN 4 THEN array('OTC') WHEN 5 THEN array('Elsewhere') ELSE CAST(array() AS ARRAY<STRING>) END").alias("exchanges"))).alias("doc"))
    return present(X.submissions_profile(docs.select(F.from_json("doc", X.SUBMISSION_DOCUMENT).alias("d")).select("d.*")), SUB_LAYOUT)


# ================================================================= prices
TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def wide_bars(spark, sf):
    o = table(spark, sf, "orders")
    return (o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).pivot("o_orderpriority", TICKERS).agg(F.avg("o_totalprice") * 1.0371193))


BARS_SQL = """
wb AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, o_orderpriority AS security_id, avg(o_totalprice) * 1.0371193::DOUBLE AS adjusted FROM orders GROUP BY ALL),
pb AS (SELECT *, CASE WHEN adjusted * 2 <= 2 * (SELECT max(adjusted) FROM wb) THEN adjusted * 2 END AS "close" FROM wb)"""
BAR_LAYOUT = "security_id date:d adjusted:4 close:4"


def _price_bars(spark, sf):
    wide = wide_bars(spark, sf)
    close = wide.select("date", *[(F.col(f"`{t}`") * 2).alias(t) for t in TICKERS])
    return price_bars(wide, close, TICKERS)


@register("s15_price_bars", sql(BAR_LAYOUT, "pb", BARS_SQL).replace("CAST(close AS", 'CAST("close" AS').replace("AS close", 'AS "close"'))
def s15(spark, sf):
    return present(_price_bars(spark, sf), BAR_LAYOUT)


def prices(spark, sf):
    """Supplier-month prices without share counts; some closes missing, some suppliers stop early."""
    b = bars(spark, sf).where("sk % 7 <> 3 OR m <= 1998 * 12 + sk % 30")
    return b.selectExpr("CAST(sk AS STRING) AS security_id", "last_day(make_date(CAST(floor((m - 1) / 12) AS INT), pmod(m - 1, 12) + 1, 1)) AS date",
                        "px AS adjusted", "CASE WHEN (sk + m) % 41 <> 0 THEN px * 1.25D END AS close", "'NYSE' AS exchange", "sk % 3000 AS sic_code")


def filings(spark, sf):
    return fact_rows(spark, sf).where("taxonomy = 'dei'").selectExpr("CAST(cik AS STRING) AS security_id", "end", "val", "filed")


def current_shares(spark, sf):
    return table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS security_id", "777.0D AS shares_now")


PRICE_SQL = """
b0 AS (SELECT l_suppkey AS sk, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(l_extendedprice) / sum(l_quantity) * 0.9137261::DOUBLE AS px FROM lineitem GROUP BY ALL),
pr AS (SELECT CAST(sk AS VARCHAR) AS security_id, last_day(make_date((m - 1) // 12, (m - 1) % 12 + 1, 1)) AS date, px AS adjusted,
              CASE WHEN (sk + m) % 41 <> 0 THEN px * 1.25::DOUBLE END AS "close", sk % 3000 AS sic_code FROM b0 WHERE sk % 7 <> 3 OR m <= 1998 * 12 + sk % 30),
fi AS (SELECT CAST(cik AS VARCHAR) AS security_id, "end", val, filed FROM shr),
sh AS (SELECT p.*, (SELECT arg_max(val, (filed, "end")) FROM fi WHERE fi.security_id = p.security_id AND filed <= p.date) AS k0,
              (SELECT min(filed) FROM fi WHERE fi.security_id = p.security_id) AS f0 FROM pr p),
nx AS (SELECT *, (SELECT arg_min(k0, s2.date) FROM sh s2 WHERE s2.security_id = sh.security_id AND s2.date > sh.date AND s2.k0 IS NOT NULL) AS k1 FROM sh),
ps AS (SELECT security_id, date, adjusted, "close", sic_code, coalesce(k0, k1, 777) AS shares, k0 IS NULL AND k1 IS NOT NULL AS shares_backfilled FROM nx)"""
SHARES_LAYOUT = "security_id date:d adjusted:4 shares:2 shares_backfilled"


def _with_shares(spark, sf):
    return shares_asof(prices(spark, sf), filings(spark, sf), current_shares(spark, sf))


@register("v20_shares_asof", sql(SHARES_LAYOUT, "ps", ROWS_SQL, PRICE_SQL))
def v20(spark, sf):
    return present(_with_shares(spark, sf), SHARES_LAYOUT)


P_LAYOUT = "security_id date:d total_return:8 price:4 shares_outstanding:2 market_cap:1 exchange sic_code:i is_delisted_this_month"


@register("v21_returns_from_prices", sql(P_LAYOUT, "y", ROWS_SQL, PRICE_SQL, f"""
cl AS (SELECT *, adjusted / lag(adjusted) OVER (PARTITION BY security_id ORDER BY date) - 1 AS total_return FROM ps
       WHERE adjusted IS NOT NULL AND "close" IS NOT NULL AND date BETWEEN DATE '{S}' - INTERVAL 1 MONTH AND DATE '{T}'),
y AS (SELECT security_id, date, total_return, "close" AS price, shares AS shares_outstanding, "close" * shares AS market_cap, 'NYSE' AS exchange, sic_code,
             date = max(date) OVER (PARTITION BY security_id) AND date < DATE '{T}' - INTERVAL 2 MONTH AS is_delisted_this_month
      FROM cl WHERE total_return IS NOT NULL)"""))
def v21(spark, sf):
    return present(returns_from_prices(_with_shares(spark, sf), S, T), P_LAYOUT)


@register("v22_proxy_benchmarks", sql("date:d sp500_total_return:8 market_vw_return:9 market_ew_return:9 risk_free_rate:9", "y", RET_SQL, f"""
ix AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, avg(o_totalprice) AS px, max(o_custkey % 7) AS yp FROM orders GROUP BY 1),
iy AS (SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS sp, CASE WHEN month(date) % 3 <> 0 THEN month(date) * 0.5::DOUBLE END AS yp FROM ix),
iz AS (SELECT date, sp, coalesce((SELECT arg_max(power(1 + z.yp / 100, 1.0::DOUBLE / 12) - 1, z.date) FROM iy z WHERE z.date <= iy.date AND z.yp IS NOT NULL), 0) AS rf FROM iy),
lg AS (SELECT r.date, r.total_return, p.market_cap AS c0 FROM ret r LEFT JOIN ret p ON p.security_id = r.security_id AND last_day(p.date + INTERVAL 1 DAY) = r.date),
mk AS (SELECT date, sum(c0 * total_return) / sum(c0) AS market_vw_return, avg(total_return) AS market_ew_return FROM lg GROUP BY date),
y AS (SELECT date, sp AS sp500_total_return, market_vw_return, market_ew_return, rf AS risk_free_rate FROM mk JOIN iz USING (date)
      WHERE sp IS NOT NULL AND date BETWEEN DATE '{S}' AND DATE '{T}')"""))
def v22_proxy(spark, sf):
    o = table(spark, sf, "orders")
    idx = (o.groupBy(F.last_day(F.to_date("o_orderdate")).alias("date")).agg(F.avg("o_totalprice").alias("adjusted"))
           .withColumn("yield_pct", ex("CASE WHEN month(date) % 3 <> 0 THEN month(date) * 0.5D END")))
    return present(proxy_benchmarks(returns(spark, sf), idx, S, T),
                   "date:d sp500_total_return:8 market_vw_return:9 market_ew_return:9 risk_free_rate:9")


# ================================================================= whole panels
def company_documents(spark, sf):
    """One nested document per company with all its tags."""
    e = fact_rows(spark, sf).withColumn("entry", F.struct(*[F.col(c).cast("string").alias(c) for c in ("start", "end", "val", "filed")]))
    units = (e.groupBy("cik", "taxonomy", "tag", "unit").agg(F.collect_list("entry").alias("entries"))
             .select("cik", "taxonomy", "tag", F.struct(F.create_map("unit", "entries").alias("units")).alias("_u")))
    tags = units.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", "_u"))).alias("_t"))
    return tags.groupBy("cik").agg(F.to_json(F.struct("cik", F.map_from_entries(F.collect_list(F.struct("taxonomy", "_t"))).alias("facts"))).alias("document"))


def company_submissions(spark, sf):
    docs = table(spark, sf, "supplier").select(F.to_json(F.struct(
        F.col("s_suppkey").alias("cik"), ex("CAST(1000 + s_suppkey % 7000 AS STRING)").alias("sic"),
        ex("CASE WHEN s_suppkey % 2 = 0 THEN array('Nasdaq', 'NYSE') ELSE array('NYSE') END").alias("exchanges"))).alias("doc"))
    return docs.select(F.from_json("doc", X.SUBMISSION_DOCUMENT).alias("d")).select("d.*")


FILED_LAYOUT = ("security_id failed no_facts current_shares_only n_months:i cap:1 exchange sic_code:i n_filings:i revenue:2")
FILED_SQL = f"""
cl AS (SELECT *, adjusted / lag(adjusted) OVER (PARTITION BY security_id ORDER BY date) - 1 AS total_return FROM ps
       WHERE adjusted IS NOT NULL AND "close" IS NOT NULL AND date BETWEEN DATE '{S}' - INTERVAL 1 MONTH AND DATE '{T}'),
rs AS (SELECT security_id, count(*) AS n, avg("close" * shares) AS cap FROM cl WHERE total_return IS NOT NULL GROUP BY security_id),
cs AS (SELECT security_id, count(*) AS n, sum(revenue_ttm) AS revenue FROM cf WHERE CAST(security_id AS BIGINT) % 10 <> 7
              AND security_id IN (SELECT security_id FROM rs) GROUP BY security_id),
px AS (SELECT security_id, max(date) FILTER ("close" IS NOT NULL) AS last FROM pr GROUP BY security_id),
f0 AS (SELECT security_id, min(filed) AS first FROM fi GROUP BY security_id),
y AS (SELECT px.security_id, rs.n IS NULL AS failed, rs.n IS NOT NULL AND cs.n IS NULL AS no_facts, f0.first IS NULL OR f0.first > px.last AS current_shares_only,
             coalesce(rs.n, 0) AS n_months, rs.cap,
             CASE WHEN rs.n IS NULL THEN NULL WHEN CAST(px.security_id AS BIGINT) % 10 = 7 THEN 'OTHER' WHEN CAST(px.security_id AS BIGINT) % 2 = 0 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange,
             CASE WHEN rs.n IS NULL THEN NULL WHEN CAST(px.security_id AS BIGINT) % 10 = 7 THEN 0 ELSE 1000 + CAST(px.security_id AS BIGINT) % 7000 END AS sic_code,
             coalesce(cs.n, 0) AS n_filings, cs.revenue
      FROM px LEFT JOIN rs USING (security_id) LEFT JOIN cs USING (security_id) LEFT JOIN f0 USING (security_id))"""


@register("v_panel_filings", sql(FILED_LAYOUT, "y", ROWS_SQL, CONCEPT_SQL, TTMD_SQL, CF_SQL,
                                 PRICE_SQL.replace("FROM shr)", "FROM shr WHERE cik % 10 <> 7)"), FILED_SQL))
def v_panel_filings(spark, sf):
    """The whole panel from one document per company and prices; one company in ten is not known to the filings."""
    idx = (table(spark, sf, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("date"))
           .agg(F.avg("o_totalprice").alias("adjusted")).withColumn("yield_pct", F.lit(3.0)))
    companies = (table(spark, sf, "supplier").where("s_suppkey % 10 <> 7")
                 .select(F.col("s_suppkey").cast("string").alias("security_id"), F.col("s_suppkey").alias("cik")))
    made, status = panel_from_filings(X.parse_facts(company_documents(spark, sf)), company_submissions(spark, sf), companies,
                                      prices(spark, sf).select("security_id", "date", "adjusted", "close"), idx, S, T,
                                      current_shares(spark, sf))
    r = made.returns.groupBy("security_id").agg(F.count(F.lit(1)).alias("n_months"), F.avg("market_cap").alias("cap"),
                                                F.max("exchange").alias("exchange"), F.max("sic_code").alias("sic_code"))
    f = made.fundamentals.groupBy("security_id").agg(F.count(F.lit(1)).alias("n_filings"), F.sum("revenue_ttm").alias("revenue"))
    out = status.join(r, "security_id", "left").join(f, "security_id", "left")
    return present(out.fillna(0, ["n_months", "n_filings"]), FILED_LAYOUT)


STOCK_FILES_SQL = ",".join([
    MSF_SQL, NAMES_SQL, SCAN_SQL, DELIST_SQL, COMPOUND_SQL, """
ret AS (SELECT CAST(permno AS VARCHAR) AS security_id, date, ret AS total_return, abs(prc) AS price, shrout * 1000 AS shares_outstanding,
               abs(prc) * (shrout * 1000) AS market_cap, CASE exchcd WHEN 1 THEN 'NYSE' WHEN 2 THEN 'AMEX' WHEN 3 THEN 'NASDAQ' ELSE 'OTHER' END AS exchange,
               coalesce(siccd, 0) AS sic_code, is_delisted_this_month FROM comp WHERE ret IS NOT NULL)""",
    *QC, FUNDA_SQL, ACANON_SQL, MERGED_SQL, """
fund AS (SELECT * FROM mg WHERE security_id IS NOT NULL AND fiscal_period_end IS NOT NULL AND available_date IS NOT NULL)""",
    RET_SQL.replace("\nret AS", "\noret AS"), f"""
mm AS (SELECT date, avg(total_return) AS e, max(total_return) AS hi, min(total_return) AS lo FROM oret GROUP BY date),
bench AS (SELECT date, CASE WHEN month(date) <> 5 AND date BETWEEN DATE '{S}' AND DATE '{T}' THEN (hi + lo) / 2 END AS sp500_total_return,
                 e AS market_vw_return, e + 0.001 AS market_ew_return, month(date) / 10000.0::DOUBLE AS risk_free_rate
          FROM mm WHERE date - 1 BETWEEN DATE '{S}' AND DATE '{T}')"""])


def stock_files(spark, sf):
    return StockFiles(msf(spark, sf), delist(spark, sf), fundq(spark, sf), funda(spark, sf), links(spark, sf),
                      *market_tables(spark, sf), names=names(spark, sf))


@register("v_panel_stock_files_backtest", ORACLES["p12_backtest_monthly"].replace(PANEL_SQL, STOCK_FILES_SQL))
def v_panel_stock_files(spark, sf):
    """From vendor files straight to a monthly backtest."""
    return present(run_backtest(panel_from_stock_files(stock_files(spark, sf), S, T), SPEC).monthly, MONTHLY_LAYOUT)
