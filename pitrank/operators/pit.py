"""Which filing was the newest public one, for every security and every month end at once.

A filing is in force from the first month end on which it is public until a filing that outranks it (later fiscal
period, or the same period published later) becomes public, or until it goes stale. Those intervals do not overlap
within a security, so every (month end, security) has at most one filing and no aggregation over the expanded
months is needed: filings move through the shuffle once, and expanding gives only rows that are used.
"""
from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import month_end_at, month_index
from ..schemas import FUNDAMENTAL_VALUES, MAX_STALENESS_DAYS
from ..sources.canonical import as_date

PUBLIC = "available_date"


class LookAheadWarning(UserWarning):
    pass


def _first_month_end(d, shift: int):
    """Index of the first month end T with add_months(T, -shift) >= d."""
    t = F.last_day(F.add_months(d, shift))
    return month_index(t) + (F.add_months(t, -shift) < d).cast("int")


def _last_month_end(d, shift: int):
    """Index of the last month end T with add_months(T, -shift) <= d."""
    t = F.last_day(F.add_months(d, shift))
    return month_index(t) - (F.add_months(t, -shift) > d).cast("int")


def filing_intervals(fundamentals: DataFrame, asof_col: str = PUBLIC,
                     max_staleness_days: int | None = MAX_STALENESS_DAYS, shift_months: int = 0,
                     horizon=None, keys: Sequence[str] = ()) -> DataFrame:
    """Keys of each filing that is ever in force, with its first and last month index (inclusive).

    ``shift_months`` looks up the state at add_months(T, -shift) for formation month T. Without a staleness limit
    a last date (``horizon``) must be given, since a filing may then stay in force for ever.
    """
    if asof_col != PUBLIC:
        warnings.warn(f"look-ahead: filings chosen by {asof_col!r}, before they were public", LookAheadWarning,
                      stacklevel=3)
    if max_staleness_days is None and horizon is None:
        raise ValueError("a horizon date is needed when staleness is not limited")
    owner = [*keys, "security_id"]
    seen = _first_month_end(F.col(asof_col), shift_months)
    # Of the filings a security makes visible in the same month only the highest can ever be chosen. This partial
    # aggregation bounds what one security sends to the window below by the number of months.
    best = (fundamentals
            .where(F.col(PUBLIC).isNotNull() & F.col("fiscal_period_end").isNotNull())
            .groupBy(*owner, seen.alias("first_month"))
            .agg(F.max(F.struct("fiscal_period_end", PUBLIC)).alias("_best"))
            .select(*owner, "first_month", "_best.*"))
    outranks = (Window.partitionBy(*owner).orderBy(F.desc("fiscal_period_end"), F.desc(PUBLIC))
                .rowsBetween(Window.unboundedPreceding, -1))
    ends = [F.min("first_month").over(outranks) - 1]
    if max_staleness_days is not None:
        ends.append(_last_month_end(F.date_add("fiscal_period_end", max_staleness_days), shift_months))
    if horizon is not None:
        ends.append(month_index(as_date(horizon)))
    last = F.least(*ends) if len(ends) > 1 else ends[0]
    return (best.withColumn("last_month", last).where(F.col("first_month") <= F.col("last_month"))
            .select(*owner, "fiscal_period_end", PUBLIC, "first_month", "last_month"))


def asof_fundamentals(fundamentals: DataFrame, formations: DataFrame | None = None, asof_col: str = PUBLIC,
                      max_staleness_days: int | None = MAX_STALENESS_DAYS, shift_months: int = 0, horizon=None,
                      values: Sequence[str] = tuple(FUNDAMENTAL_VALUES), keys: Sequence[str] = ()) -> DataFrame:
    """(formation_date, security_id) -> newest public filing.

    ``formations`` (column ``formation_date``) holds at most one row per calendar month, so it is broadcast; where it carries
    some of the ``keys``, a date counts for these only. Only keys
    are expanded to months and cut to the formation dates; values are joined afterwards, so a filing no date needs
    never moves its values. Filings are unique on (security, period, publication date), so the join that brings the values back spreads
    evenly even when one security has very many filings.
    """
    filing = [*keys, "security_id", "fiscal_period_end", PUBLIC]
    chosen = (filing_intervals(fundamentals, asof_col, max_staleness_days, shift_months, horizon, keys)
              .select(*filing, F.explode(F.sequence("first_month", "last_month")).alias("_m")))
    if formations is not None:
        shared = [k for k in keys if k in formations.columns]
        calendar = formations.select(*shared, month_index("formation_date").alias("_m")).distinct()
        chosen = chosen.join(F.broadcast(calendar), [*shared, "_m"], "left_semi")
    return (chosen.join(fundamentals.select(*filing, *values), filing)
            .select(month_end_at("_m").alias("formation_date"), *filing, *values))
