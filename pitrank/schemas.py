"""Canonical table schemas and the fixed values shared by the whole package."""
from __future__ import annotations

from pyspark.sql import types as T

# Canonical column names and units (money in dollars, share counts in shares).
RETURNS = T.StructType([
    T.StructField("security_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("total_return", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("shares_outstanding", T.DoubleType()),
    T.StructField("market_cap", T.DoubleType()),
    T.StructField("exchange", T.StringType()),
    T.StructField("sic_code", T.LongType()),
    T.StructField("is_delisted_this_month", T.BooleanType()),
])

FLOW_COLUMNS = ["ebit_ttm", "revenue_ttm", "gross_profit_ttm", "net_income_ttm", "operating_cash_flow_ttm",
                "capex_ttm", "dividends_ttm"]
STOCK_COLUMNS = ["current_assets", "cash", "current_liabilities", "short_term_debt", "long_term_debt", "net_ppe",
                 "total_assets", "book_equity", "preferred_stock", "minority_interest", "shares_diluted"]
FUNDAMENTAL_VALUES = FLOW_COLUMNS + STOCK_COLUMNS

FUNDAMENTALS = T.StructType(
    [T.StructField("security_id", T.StringType()),
     T.StructField("fiscal_period_end", T.DateType()),
     T.StructField("available_date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in FUNDAMENTAL_VALUES])

BENCHMARKS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("sp500_total_return", T.DoubleType()),
    T.StructField("market_vw_return", T.DoubleType()),
    T.StructField("market_ew_return", T.DoubleType()),
    T.StructField("risk_free_rate", T.DoubleType()),
])

MAJOR_EXCHANGES = ("NYSE", "AMEX", "NASDAQ")

# Benchmark series of a monthly result and their report labels.
BENCHMARK_LABELS = {
    "universe_ew": "EW universe",
    "market_ew_return": "EW market",
    "market_vw_return": "VW market",
    "sp500_total_return": "S&P 500",
}

MAX_STALENESS_DAYS = 548
LOOKBACK_MONTHS = 13
FUNDAMENTALS_LEAD_MONTHS = 18
