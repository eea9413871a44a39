"""Quarterly and annual accounting files of a data vendor to canonical fundamentals."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import FUNDAMENTAL_VALUES
from ..sources.canonical import as_date, between_dates
from .equity import OPEN_END

# File format, units, publication lags, link types and item names of the vendor files.
STANDARD_FORMAT = {"indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "consol": "C"}
UNIT = 1e6
QUARTERLY_LAG_DAYS = 90
ANNUAL_LAG_MONTHS = 4
LINK_TYPES = ("LU", "LC")
LINK_PRIMARY = ("P", "C")
YTD_ITEMS = ("oancfy", "capxy", "dvy")
QUARTERLY_ITEMS = {
    "ebit_ttm": "oiadpq_ttm", "revenue_ttm": "saleq_ttm", "gross_profit_ttm": "gpq_ttm", "net_income_ttm": "niq_ttm",
    "operating_cash_flow_ttm": "oancfq_ttm", "capex_ttm": "capxq_ttm", "dividends_ttm": "dvq_ttm",
    "current_assets": "actq", "cash": "cheq", "current_liabilities": "lctq", "short_term_debt": "dlcq",
    "long_term_debt": "dlttq", "net_ppe": "ppentq", "total_assets": "atq", "book_equity": "beq",
    "preferred_stock": "pstkq", "minority_interest": "mibq", "shares_diluted": "cshfdq"}
ANNUAL_ITEMS = {
    "ebit_ttm": "oiadp", "revenue_ttm": "sale", "gross_profit_ttm": "gp", "net_income_ttm": "ni",
    "operating_cash_flow_ttm": "oancf", "capex_ttm": "capx", "dividends_ttm": "dvt", "current_assets": "act",
    "cash": "che", "current_liabilities": "lct", "short_term_debt": "dlc", "long_term_debt": "dltt",
    "net_ppe": "ppent", "total_assets": "at", "book_equity": "be", "preferred_stock": "pstk",
    "minority_interest": "mib", "shares_diluted": "cshfd"}
QUARTERLY_COLUMNS = ["gvkey", "datadate", "fyearq", "fqtr", "rdq", "saleq", "cogsq", "oiadpq", "niq", "oancfy",
                     "capxy", "dvy", "actq", "cheq", "lctq", "dlcq", "dlttq", "ppentq", "atq", "ceqq", "pstkq",
                     "mibq", "txditcq", "cshfdq"]
ANNUAL_COLUMNS = ["gvkey", "datadate", "fyear", "sale", "cogs", "oiadp", "ni", "oancf", "capx", "dvt", "act", "che",
                  "lct", "dlc", "dltt", "ppent", "at", "ceq", "pstk", "mib", "txditc", "cshfd"]


def accounting_scan(df: DataFrame, columns: Sequence[str], start, end) -> DataFrame:
    """Standard-format rows from two years before ``start``; filters and columns reach the scan."""
    rows = between_dates(df, "datadate", F.add_months(as_date(start), -24), end)
    for c, v in STANDARD_FORMAT.items():
        rows = rows.where(F.col(c) == v)
    return rows.select(*columns)


def link_scan(links: DataFrame) -> DataFrame:
    return links.select("gvkey", "lpermno", "linktype", "linkprim", "linkdt", "linkenddt")


def ytd_to_quarterly(fundq: DataFrame, items: Sequence[str] = YTD_ITEMS) -> DataFrame:
    """Year-to-date items to quarters (``xy`` -> ``xq``) by differencing inside a fiscal year.

    The first quarter is the year-to-date value; after a missing quarter, or a missing previous value, the result is
    NULL. A window partition is one company's fiscal year.
    """
    w = Window.partitionBy("gvkey", "fyearq").orderBy("fqtr")
    follows = F.lag("fqtr").over(w) == F.col("fqtr") - 1
    return fundq.withColumns({
        c[:-1] + "q": F.when(F.col("fqtr") == 1, F.col(c)).when(follows, F.col(c) - F.lag(c).over(w)) for c in items})


def build_ttm(fq: DataFrame, flows: Mapping[str, str]) -> DataFrame:
    """Sums over four consecutive quarters; NULL unless the last three gaps are 80 to 100 days and nothing is missing."""
    w = Window.partitionBy("gvkey").orderBy("datadate")
    gap_ok = F.coalesce(F.datediff("datadate", F.lag("datadate").over(w)).between(80, 100), F.lit(False))
    out = fq.withColumn("_ok", gap_ok.cast("int"))
    three, four = w.rowsBetween(-2, 0), w.rowsBetween(-3, 0)
    steady = F.sum("_ok").over(three) == 3
    return out.withColumns({dst: F.when(steady & (F.count(src).over(four) == 4), F.sum(src).over(four))
                            for src, dst in flows.items()}).drop("_ok")


def availability_date(annual: bool = False, announced: str | None = "rdq") -> Column:
    """Announcement date when it is present and not before the period end, else the period end plus a fixed lag."""
    if annual or announced is None:
        return F.add_months("datadate", ANNUAL_LAG_MONTHS) if annual else F.date_add("datadate", QUARTERLY_LAG_DAYS)
    return F.when(F.col(announced) >= F.col("datadate"), F.col(announced)).otherwise(
        F.date_add("datadate", QUARTERLY_LAG_DAYS))


def resolve_links(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``permno`` through the link valid at ``datadate``, the primary one first; unlinked rows are dropped.

    A company has few links: they travel as one short array per company, so accounting rows are read once and joined
    once, on the company, and the best link is picked inside the row.
    """
    valid = (links.where(F.col("linktype").isin(*LINK_TYPES) & F.col("linkprim").isin(*LINK_PRIMARY))
             .groupBy("gvkey").agg(F.collect_set(F.struct(
                 (F.col("linkprim") != "P").alias("second"), "lpermno", F.col("linkdt").alias("since"),
                 F.coalesce("linkenddt", as_date(OPEN_END)).alias("until"))).alias("_links")))
    at = F.filter("_links", lambda x: F.col("datadate").between(x["since"], x["until"]))
    best = F.array_min(F.transform(at, lambda x: F.struct(x["second"].alias("second"), x["lpermno"].alias("lpermno"))))
    return (accounts.join(valid, "gvkey").withColumn("permno", best["lpermno"])
            .where(F.col("permno").isNotNull()).drop("_links"))


def _canonical(df: DataFrame, items: Mapping[str, str]) -> DataFrame:
    return df.select(F.col("permno").cast("long").cast("string").alias("security_id"),
                     F.col("datadate").alias("fiscal_period_end"), "available_date",
                     *[(F.col(items[c]).cast("double") * UNIT).alias(c) for c in FUNDAMENTAL_VALUES])


def quarterly_to_canonical(fundq: DataFrame, links: DataFrame) -> DataFrame:
    f = ytd_to_quarterly(fundq).withColumns({
        "gpq": F.col("saleq") - F.col("cogsq"), "beq": F.col("ceqq") + F.coalesce("txditcq", F.lit(0.0))})
    f = build_ttm(f, {s[:-4]: s for s in QUARTERLY_ITEMS.values() if s.endswith("_ttm")})
    return _canonical(resolve_links(f.withColumn("available_date", availability_date()), links), QUARTERLY_ITEMS)


def annual_to_canonical(funda: DataFrame, links: DataFrame) -> DataFrame:
    f = funda.withColumns({"gp": F.col("sale") - F.col("cogs"), "be": F.col("ceq") + F.coalesce("txditc", F.lit(0.0)),
                           "available_date": availability_date(annual=True)})
    return _canonical(resolve_links(f, links), ANNUAL_ITEMS)


def merge_quarterly_annual(quarterly: DataFrame, annual: DataFrame) -> DataFrame:
    """Annual rows only for periods the quarterly file does not have. Each side is computed once."""
    both = quarterly.withColumn("_annual", F.lit(0)).unionByName(annual.withColumn("_annual", F.lit(1)))
    period = Window.partitionBy("security_id", "fiscal_period_end")
    return (both.withColumn("_best", F.min("_annual").over(period)).where(F.col("_annual") == F.col("_best"))
            .drop("_annual", "_best"))


def finish_fundamentals(df: DataFrame) -> DataFrame:
    """Canonical columns and types, no NULL keys, one row per key (of equal keys, the smallest row)."""
    key = ["security_id", "fiscal_period_end", "available_date"]
    have = set(df.columns)
    values = [(F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in FUNDAMENTAL_VALUES]
    typed = df.dropna(subset=key).select(
        F.col("security_id").cast("string"), F.col("fiscal_period_end").cast("date"), F.col("available_date").cast("date"), *values)
    return typed.groupBy(*key).agg(F.min(F.struct(*FUNDAMENTAL_VALUES)).alias("_v")).select(*key, "_v.*")
