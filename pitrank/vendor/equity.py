"""Monthly stock files of a data vendor, in two layouts, to canonical returns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.canonical import between_dates

# Vendor codes.
EXCHANGE_BY_CODE = {1: "NYSE", 2: "AMEX", 3: "NASDAQ"}
EXCHANGE_BY_LETTER = {"N": "NYSE", "A": "AMEX", "Q": "NASDAQ"}
COMMON_SHARE_CODES = (10, 11)
OPEN_END = "2099-12-31"
SHARE_UNIT = 1e3
MISSING_DELISTING_RETURN = -0.30
CIZ_COMMON_STOCK = {"sharetype": ("NS",), "securitytype": ("EQTY",), "securitysubtype": ("COM",), "usincflg": ("Y",),
                    "issuertype": ("ACOR", "CORP"), "primaryexch": ("N", "A", "Q"), "conditionaltype": ("RW",),
                    "tradingstatusflg": ("A",)}


def legacy_stock_scan(msf: DataFrame, names: DataFrame, start, end) -> DataFrame:
    """Stock file rows with the name record valid on their date; US common stock on the three exchanges only.

    The code filters and the date bounds come before the join, so both scans are pruned. Name records of a security
    do not overlap, so the range is a residual on an equality join.
    """
    valid = (names.where(F.col("shrcd").isin(*COMMON_SHARE_CODES) & F.col("exchcd").isin(*EXCHANGE_BY_CODE))
             .select("permno", "namedt", F.coalesce("nameendt", F.lit(OPEN_END).cast("date")).alias("_until"),
                     "shrcd", "exchcd", "siccd"))
    rows = between_dates(msf, "date", start, end).select("permno", "date", "ret", "prc", "shrout")
    return (rows.join(valid, "permno").where(F.col("date").between(F.col("namedt"), F.col("_until")))
            .drop("namedt", "_until"))


def legacy_delistings(delist: DataFrame) -> DataFrame:
    return delist.select("permno", "dlstdt", "dlret", "dlstcd")


def ciz_stock_scan(msf2: DataFrame, start, end) -> DataFrame:
    """New layout: common-stock flags as equality predicates, all pushed to the scan."""
    rows = between_dates(msf2, "mthcaldt", start, end)
    for c, allowed in CIZ_COMMON_STOCK.items():
        rows = rows.where(F.col(c).isin(*allowed) if len(allowed) > 1 else F.col(c) == allowed[0])
    return rows.select("permno", "mthcaldt", "mthret", "mthprc", "shrout", "primaryexch", "siccd")


def ciz_delistings(stkdelists: DataFrame) -> DataFrame:
    return stkdelists.select("permno", "delistingdt", "delret", "delreasontype")


def performance_delisting(code: Column) -> Column:
    return (code == 500) | code.between(520, 584)


def compound_delistings(msf: DataFrame, delist: DataFrame, fill: float = MISSING_DELISTING_RETURN) -> DataFrame:
    """Folds the delisting return into the delisting month, adding that month where the stock has no row.

    ``msf`` has one row per (permno, month). The last delisting of a security counts; rows after it are dropped.
    Delistings of securities outside ``msf`` are ignored. Missing delisting returns become ``fill`` for
    performance-related codes and 0 otherwise.
    """
    msf = msf.withColumn("date", F.last_day("date"))
    latest = (delist.where(F.col("dlstdt").isNotNull()).groupBy("permno")
              .agg(F.max(F.struct("dlstdt", "dlret", "dlstcd")).alias("_d"))
              .join(msf.select("permno").distinct(), "permno", "left_semi"))
    filled = F.coalesce(F.col("_d.dlret"), F.when(performance_delisting(F.coalesce("_d.dlstcd", F.lit(0))), F.lit(float(fill)))
                        .otherwise(F.lit(0.0)))
    dl = latest.select("permno", F.last_day("_d.dlstdt").alias("date"), filled.alias("_dl"))
    last = dl.select("permno", F.col("date").alias("_dl_date"))
    kept = (msf.withColumn("_row", F.lit(True)).join(last, "permno", "left")
            .where(F.col("_dl_date").isNull() | (F.col("date") <= F.col("_dl_date"))).drop("_dl_date"))
    both = kept.join(dl, ["permno", "date"], "full_outer")
    ret = (F.when(F.col("_row").isNull(), F.col("_dl"))
           .when(F.col("_dl").isNotNull(), (1 + F.coalesce("ret", F.lit(0.0))) * (1 + F.col("_dl")) - 1)
           .otherwise(F.col("ret")))
    return (both.withColumn("ret", ret).withColumn("is_delisted_this_month", F.col("_dl").isNotNull())
            .drop("_row", "_dl"))


def _canonical(df: DataFrame, date: Column, ret: str, price: str, exchange: Column) -> DataFrame:
    px = F.abs(F.col(price))
    shares = F.col("shrout") * SHARE_UNIT
    return df.where(F.col(ret).isNotNull()).select(
        F.col("permno").cast("long").cast("string").alias("security_id"), F.last_day(date).alias("date"),
        F.col(ret).cast("double").alias("total_return"), px.cast("double").alias("price"),
        shares.cast("double").alias("shares_outstanding"), (px * shares).cast("double").alias("market_cap"),
        F.coalesce(exchange, F.lit("OTHER")).alias("exchange"), F.coalesce(F.col("siccd").cast("long"), F.lit(0)).alias("sic_code"),
        F.coalesce("is_delisted_this_month", F.lit(False)).alias("is_delisted_this_month"))


def _lookup(mapping: dict, key: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def legacy_to_returns(msf: DataFrame) -> DataFrame:
    """Old layout after :func:`compound_delistings`; a negative price marks a bid-ask midpoint."""
    return _canonical(msf, F.col("date"), "ret", "prc", _lookup(EXCHANGE_BY_CODE, "exchcd"))


def ciz_to_returns(msf2: DataFrame, delist: DataFrame) -> DataFrame:
    """New layout: returns include delisting already, so the delisting month is only flagged."""
    flags = (delist.select("permno", F.last_day("delistingdt").alias("_month")).distinct()
             .withColumn("is_delisted_this_month", F.lit(True)))
    rows = msf2.withColumn("_month", F.last_day("mthcaldt")).join(flags, ["permno", "_month"], "left")
    return _canonical(rows, F.col("mthcaldt"), "mthret", "mthprc", _lookup(EXCHANGE_BY_LETTER, "primaryexch"))


def index_benchmarks(market: DataFrame, large: DataFrame, risk_free: DataFrame, start, end) -> DataFrame:
    """Market index, large-company index and risk-free rate, snapped to month ends; the market sets the months."""
    m = between_dates(market, "date", start, end).select(
        F.last_day("date").alias("date"), F.col("vwretd").alias("market_vw_return"), F.col("ewretd").alias("market_ew_return"))
    sp = between_dates(large, "caldt", start, end).select(F.last_day("caldt").alias("date"),
                                                          F.col("vwretd").alias("sp500_total_return"))
    rf = between_dates(risk_free, "date", F.add_months(F.lit(str(start)).cast("date"), -1), end).select(
        F.last_day("date").alias("date"), F.col("rf").alias("risk_free_rate"))
    return (m.join(sp, "date", "left").join(rf, "date", "left")
            .select("date", "sp500_total_return", "market_vw_return", "market_ew_return", "risk_free_rate"))
