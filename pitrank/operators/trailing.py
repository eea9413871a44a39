"""Trailing return statistics over calendar-month ranges, evaluated for every row of the panel at once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import log_growth, month_index

MIN_MONTHS = 9


def month_range(keys: Sequence[str], first: int, last: int):
    """Window over calendar months relative to the row. A security has one row per month (contract), so the frame
    holds at most ``last - first + 1`` rows and a partition at most one row per panel month."""
    return Window.partitionBy(*keys, "security_id").orderBy("_m").rangeBetween(first, last)


def with_trailing(returns: DataFrame, lookback: int = 12, skip: int = 1, shift: int = 0, momentum: str = "mom_12_1",
                  volatility: str | None = "vol_12m", keys: Sequence[str] = ()) -> DataFrame:
    """Adds momentum over months (T-lookback, T-skip] and annualised volatility over (T-lookback, T].

    ``shift`` moves both windows into the future; only the audits use it. Gaps count as missing months.
    """
    r = F.col("total_return")
    mom = month_range(keys, shift - lookback + 1, shift - skip)
    out = returns.withColumn("_m", month_index("date"))
    add = {momentum: F.when(F.count(r).over(mom) >= min(MIN_MONTHS, lookback - skip),
                            F.expm1(F.sum(log_growth(r)).over(mom)))}
    if volatility:
        vol = month_range(keys, shift - lookback + 1, shift)
        add[volatility] = F.when(F.count(r).over(vol) >= MIN_MONTHS, F.stddev_samp(r).over(vol) * F.sqrt(F.lit(12.0)))
    return out.withColumns(add).drop("_m")


def forward_returns(returns: DataFrame, horizon: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Return compounded over a security's next ``horizon`` rows; shorter when it dies, NULL when nothing follows."""
    w = Window.partitionBy(*keys, "security_id").orderBy("date").rowsBetween(1, horizon)
    r = F.col("total_return")
    return returns.select(*keys, "security_id", "date",
                          F.when(F.count(r).over(w) > 0, F.expm1(F.sum(log_growth(r)).over(w))).alias("fwd"))
