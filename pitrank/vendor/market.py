"""Returns and benchmark series derived from prices."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import month_index, safe_div
from ..operators.universe import top_per_group
from ..sources.canonical import as_date


def with_lagged_cap(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Capitalisation one calendar month earlier; NULL when the security had no row then."""
    per = Window.partitionBy(*keys, "security_id").orderBy("date")
    m = month_index("date")
    return returns.withColumn("lagged_cap", F.when(F.lag(m).over(per) == m - 1, F.lag("market_cap").over(per)))


def weighted_return() -> Column:
    """Lagged-cap-weighted return of the rows of a group."""
    r, w = F.col("total_return"), F.col("lagged_cap")
    return safe_div(F.sum(w * r), F.sum(F.when(r.isNotNull(), w)))


def market_returns(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Value-weighted (by lagged capitalisation) and equal-weighted return of everything alive."""
    return (with_lagged_cap(returns, keys).groupBy(*keys, "date")
            .agg(weighted_return().alias("market_vw_return"), F.avg("total_return").alias("market_ew_return")))


def top_k_index(returns: DataFrame, k: int = 500, keys: Sequence[str] = ()) -> DataFrame:
    """Lagged-cap-weighted return of the ``k`` largest securities of each month."""
    rows = with_lagged_cap(returns, keys).where(F.col("lagged_cap").isNotNull() & F.col("total_return").isNotNull())
    top = top_per_group(rows, [*keys, "date"], [F.desc("lagged_cap"), F.asc("security_id")], k, by="lagged_cap")
    return top.groupBy(*keys, "date").agg(weighted_return().alias("sp500_total_return"))


def panel_benchmarks(returns: DataFrame, k: int = 500, risk_free: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical benchmark table computed from a panel itself."""
    at = [*keys, "date"]
    return (market_returns(returns, keys).join(top_k_index(returns, k, keys), at, "left")
            .select(*at, "sp500_total_return", "market_vw_return", "market_ew_return",
                    F.lit(float(risk_free)).alias("risk_free_rate")))


def yield_to_monthly(annual_pct: Column) -> Column:
    """Annual yield in percent to a monthly rate."""
    return F.pow(1 + annual_pct / 100, F.lit(1.0 / 12)) - 1


def carried_forward(x: Column | str, order: str = "date", keys: Sequence[str] = ()) -> Column:
    base = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    return F.last(x, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def proxy_benchmarks(returns: DataFrame, index_prices: DataFrame, start=None, end=None) -> DataFrame:
    """Benchmarks from a panel plus two market series: ``index_prices`` has date, adjusted (index proxy) and yield_pct.

    Months without an index return are dropped; a missing yield is carried forward, then 0. The index frame has one
    row per month.
    """
    w = Window.orderBy("date")
    idx = index_prices.select(
        "date", (safe_div("adjusted", F.lag("adjusted").over(w)) - 1).alias("sp500_total_return"),
        F.coalesce(carried_forward(yield_to_monthly(F.col("yield_pct"))), F.lit(0.0)).alias("risk_free_rate"))
    out = market_returns(returns).join(F.broadcast(idx), "date").where(F.col("sp500_total_return").isNotNull())
    if start is not None:
        out = out.where(F.col("date").between(as_date(start), as_date(end)))
    return out.select("date", "sp500_total_return", "market_vw_return", "market_ew_return", "risk_free_rate")


def returns_from_prices(prices: DataFrame, start, end) -> DataFrame:
    """``prices``: security_id, date, adjusted, close, shares, exchange, sic_code -> canonical returns.

    Rows without both prices are dropped first, so a return spans them; the first row of a security has none. A
    security whose last row is more than two months before ``end`` is flagged as having stopped trading.
    """
    rows = (prices.where(F.col("adjusted").isNotNull() & F.col("close").isNotNull())
            .where(F.col("date").between(F.add_months(as_date(start), -1), as_date(end))))
    per = Window.partitionBy("security_id").orderBy("date")
    r = (rows.withColumn("total_return", safe_div("adjusted", F.lag("adjusted").over(per)) - 1)
         .where(F.col("total_return").isNotNull() & F.col("shares").isNotNull())
         .withColumn("_last", F.max("date").over(Window.partitionBy("security_id"))))
    stopped = (F.col("date") == F.col("_last")) & (F.col("_last") < F.add_months(as_date(end), -2))
    return r.select("security_id", "date", "total_return", F.col("close").alias("price"),
                    F.col("shares").alias("shares_outstanding"), (F.col("close") * F.col("shares")).alias("market_cap"),
                    F.coalesce("exchange", F.lit("OTHER")).alias("exchange"),
                    F.coalesce(F.col("sic_code").cast("long"), F.lit(0)).alias("sic_code"),
                    stopped.alias("is_delisted_this_month"))


def shares_asof(prices: DataFrame, filings: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Adds ``shares``: the latest share count filed on or before the month end.

    Months before the first filing take the next known value, which looks ahead; ``shares_backfilled`` marks them.
    Securities without any filing use ``current`` (security_id, shares_now). Prices and filings are stacked and
    ordered once per security instead of being joined on an inequality.
    """
    last = (filings.groupBy("security_id", F.col("filed").alias("date"))
            .agg(F.max_by("val", "end").alias("_val")))
    probes = prices.withColumn("_val", F.lit(None).cast("double")).withColumn("_probe", F.lit(True))
    stack = last.withColumn("_probe", F.lit(False)).unionByName(probes, allowMissingColumns=True)
    per = Window.partitionBy("security_id").orderBy("date", "_probe")
    known = F.last("_val", ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy("security_id").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = stack.withColumn("_known", known).where("_probe")
    out = out.withColumn("_next", F.last("_known", ignorenulls=True).over(back))
    shares = F.coalesce("_known", "_next")
    if current is not None:
        out = out.join(current.select("security_id", "shares_now"), "security_id", "left")
        shares = F.coalesce(shares, F.col("shares_now").cast("double"))
    return (out.withColumn("shares", shares)
            .withColumn("shares_backfilled", F.col("_known").isNull() & F.col("_next").isNotNull())
            .select(*prices.columns, "shares", "shares_backfilled"))
