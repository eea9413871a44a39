"""Whole panels from vendor files or from filing documents and prices."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import materialize
from ..sources.canonical import Panel, clean_nan
from .accounting import (ANNUAL_COLUMNS, QUARTERLY_COLUMNS, accounting_scan, annual_to_canonical, finish_fundamentals,
                         link_scan, merge_quarterly_annual, quarterly_to_canonical)
from .equity import (MISSING_DELISTING_RETURN, ciz_delistings, ciz_stock_scan, ciz_to_returns, compound_delistings,
                     index_benchmarks, legacy_delistings, legacy_stock_scan, legacy_to_returns)
from .facts import company_fundamentals, flatten_facts, shares_history, submissions_profile
from .market import proxy_benchmarks, returns_from_prices, shares_asof


@dataclass(frozen=True)
class StockFiles:
    """Vendor tables. With ``names`` the stock file has the old layout, without it the new one."""
    stock: DataFrame
    delistings: DataFrame
    quarterly: DataFrame
    annual: DataFrame
    links: DataFrame
    market_index: DataFrame
    large_index: DataFrame
    risk_free: DataFrame
    names: DataFrame | None = None


def panel_from_stock_files(files: StockFiles, start, end, fill: float = MISSING_DELISTING_RETURN) -> Panel:
    """Returns, fundamentals and benchmarks from stock, accounting and index files of either layout."""
    if files.names is not None:
        rows = legacy_stock_scan(files.stock, files.names, start, end)
        returns = legacy_to_returns(compound_delistings(rows, legacy_delistings(files.delistings), fill))
    else:
        returns = ciz_to_returns(ciz_stock_scan(files.stock, start, end), ciz_delistings(files.delistings))
    links = link_scan(files.links)
    quarterly = quarterly_to_canonical(accounting_scan(files.quarterly, QUARTERLY_COLUMNS, start, end), links)
    annual = annual_to_canonical(accounting_scan(files.annual, ANNUAL_COLUMNS, start, end), links)
    return Panel(clean_nan(returns), clean_nan(finish_fundamentals(merge_quarterly_annual(quarterly, annual))),
                 clean_nan(index_benchmarks(files.market_index, files.large_index, files.risk_free, start, end)))


def panel_from_filings(facts: DataFrame, submissions: DataFrame, companies: DataFrame, prices: DataFrame,
                       index_prices: DataFrame, start, end, current_shares: DataFrame | None = None,
                       quarantine: DataFrame | None = None) -> tuple[Panel, DataFrame]:
    """A panel from filing documents and monthly prices, and a status table.

    ``facts`` and ``submissions`` are parsed documents, one per company; ``companies`` maps security_id to cik;
    ``prices`` has security_id, date, adjusted, close; ``index_prices`` date, adjusted, yield_pct; ``current_shares``
    security_id, shares_now for securities without filed counts. Status has one row per security with prices:
    ``failed`` (no returns), ``no_facts`` (returns but no fundamentals), ``current_shares_only`` (no count was filed
    until its last price). With a ``quarantine`` of documents that could not be read (``facts.sorted_out``) it also has
    their number, ``n_unreadable``; other companies are not affected by them.
    """
    reported = materialize(flatten_facts(facts))  # share counts and fundamentals both start from it
    owner = companies.select("security_id", "cik").distinct()
    profile = owner.join(submissions_profile(submissions), "cik", "left").select("security_id", "exchange", "sic_code")
    counts = materialize(owner.join(shares_history(reported), "cik").select("security_id", "end", "val", "filed"))
    priced = prices.join(profile, "security_id", "left")
    returns = materialize(returns_from_prices(shares_asof(priced, counts, current_shares), start, end))
    alive = returns.select("security_id").distinct()
    own = company_fundamentals(reported).withColumnRenamed("security_id", "_cik")
    fundamentals = materialize(
        owner.join(alive, "security_id", "left_semi").withColumn("_cik", F.col("cik").cast("string"))
        .join(own, "_cik").drop("_cik", "cik"))
    benchmarks = proxy_benchmarks(returns, index_prices, start, end)
    last = (prices.where(F.col("adjusted").isNotNull() & F.col("close").isNotNull())
            .groupBy("security_id").agg(F.max("date").alias("_last")))
    first = counts.groupBy("security_id").agg(F.min("filed").alias("_first"))
    mark = F.lit(True)
    status = (prices.select("security_id").distinct().join(last, "security_id", "left").join(first, "security_id", "left")
              .join(alive.withColumn("_alive", mark), "security_id", "left")
              .join(fundamentals.select("security_id").distinct().withColumn("_facts", mark), "security_id", "left")
              .select("security_id", F.col("_alive").isNull().alias("failed"),
                      (F.col("_alive").isNotNull() & F.col("_facts").isNull()).alias("no_facts"),
                      F.coalesce(F.col("_first") > F.col("_last"), F.col("_first").isNull()).alias("current_shares_only")))
    if quarantine is not None:
        unread = (owner.join(quarantine.groupBy("cik").agg(F.count(F.lit(1)).alias("_n")), "cik")
                  .groupBy("security_id").agg(F.sum("_n").alias("_n")))
        status = (status.join(unread, "security_id", "left")
                  .withColumn("n_unreadable", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n"))
    return Panel(clean_nan(returns), clean_nan(fundamentals), clean_nan(benchmarks)), status
