"""Monthly price bars that arrive wide (one column per ticker)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def wide_to_long(wide: DataFrame, tickers: Sequence[str], value: str, date: str = "date") -> DataFrame:
    """(security_id, date, value) with dates snapped to month ends; missing prices give no row."""
    return (wide.unpivot([date], list(tickers), "security_id", value)
            .select("security_id", F.last_day(F.col(date)).alias("date"), value).where(F.col(value).isNotNull()))


def price_bars(adjusted: DataFrame, close: DataFrame, tickers: Sequence[str], date: str = "date") -> DataFrame:
    """Adjusted and raw closes side by side in long form."""
    key = ["security_id", "date"]
    return wide_to_long(adjusted, tickers, "adjusted", date).join(wide_to_long(close, tickers, "close", date), key, "full_outer")
