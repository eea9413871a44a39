"""Report tables over monthly results. ``keys`` (run, panel, configuration) go into every grouping."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import stats
from ..functions.columns import month_index, safe_div
from ..schemas import BENCHMARK_LABELS

RF = "risk_free_rate"


def split_periods(monthly: DataFrame, split_date: str | None) -> DataFrame:
    """Repeats each month under the labels it belongs to; the split day is in-sample."""
    labels = [F.lit("full")]
    if split_date:
        labels.append(F.when(F.col("date") <= F.lit(split_date).cast("date"), F.lit("in")).otherwise(F.lit("out")))
    return monthly.withColumn("period", F.explode(F.array(*labels)))


def series_long(monthly: DataFrame, series: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide monthly table to (keys, date, rf, series, r)."""
    have = [c for c in series if c in monthly.columns]
    rf = [RF] if RF in monthly.columns else []
    return (monthly.unpivot([*keys, "date", *rf], have, "_col", "r")
            .withColumn("series", F.create_map(*[F.lit(x) for c in have for x in (c, series[c])])[F.col("_col")])
            .drop("_col"))


SERIES = {"net": "Strategy (net)", "gross": "Strategy (gross)", **BENCHMARK_LABELS}


def wealth_path(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wealth, running peak and drawdown per month. A missing month leaves wealth unchanged.

    One row per month and series, so a window partition is as long as the calendar.
    """
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (long.withColumn("wealth", F.product(1 + F.coalesce("r", F.lit(0.0))).over(upto))
            .withColumn("peak_wealth", F.max("wealth").over(upto))
            .withColumn("drawdown", F.try_divide("wealth", "peak_wealth") - 1))


def max_drawdowns(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deepest loss per series with its peak, trough and recovery dates and its length in months."""
    path = wealth_path(long, keys)
    all_rows = Window.partitionBy(*keys)
    trough = F.min(F.struct("drawdown", "date", "peak_wealth")).over(all_rows)
    marked = (path.withColumn("_t", trough)
              .withColumn("_last", F.max("date").over(all_rows)))
    before = F.col("date") <= F.col("_t.date")
    recovered = (F.col("date") >= F.col("_t.date")) & (F.col("wealth") >= F.col("_t.peak_wealth"))
    # earliest date of the highest wealth up to the trough: the largest wealth, then the smallest day number
    peak = F.max(F.when(before, F.struct("wealth", (-F.unix_date("date")).alias("_d"), F.col("date").alias("peak"))))
    out = marked.groupBy(*keys).agg(
        F.first("_t").alias("_t"), F.first("_last").alias("_last"), peak.alias("_p"),
        F.min(F.when(recovered, F.col("date"))).alias("recovery"))
    end = F.coalesce("recovery", "_last")
    return out.select(*keys, F.col("_t.drawdown").alias("max_drawdown"), F.col("_p.peak").alias("peak"),
                      F.col("_t.date").alias("trough"), "recovery",
                      (month_index(end) - month_index("_p.peak")).alias("duration_months"),
                      F.col("recovery").isNotNull().alias("recovered"))


def summary_table(monthly: DataFrame, keys: Sequence[str] = (), series: Mapping[str, str] = SERIES) -> DataFrame:
    """Growth, risk, drawdown and extremes of the strategy and each benchmark."""
    long = series_long(monthly, series, keys)
    group = [*keys, "series"]
    base = long.groupBy(*group).agg(
        stats.cagr("r").alias("cagr"), stats.ann_vol("r").alias("ann_vol"), stats.sharpe("r", RF).alias("sharpe"),
        stats.sortino("r", RF).alias("sortino"), F.max("r").alias("best_month"), F.min("r").alias("worst_month"),
        F.count(F.lit(1)).alias("months"))
    dd = max_drawdowns(long, group).select(*group, "max_drawdown", F.col("duration_months").alias("drawdown_months"))
    return base.join(dd, group)


def calendar_years(monthly: DataFrame, keys: Sequence[str] = (), strategy: str = "net",
                   benchmarks: Mapping[str, str] = BENCHMARK_LABELS) -> DataFrame:
    """Compounded return per calendar year, excess over each benchmark, number of months."""
    have = [c for c in benchmarks if c in monthly.columns]

    def year_return(c: str):
        return F.coalesce(F.product(1 + F.col(c)), F.lit(1.0)) - 1

    out = monthly.groupBy(*keys, F.year("date").alias("year")).agg(
        year_return(strategy).alias("strategy"), *[year_return(c).alias(c) for c in have],
        F.count(strategy).alias("months"))
    return out.withColumns({f"vs_{c}": F.col("strategy") - F.col(c) for c in have})


def hit_rates(calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of full calendar years in which each benchmark was beaten."""
    cols = [c for c in calendar.columns if c.startswith("vs_")]
    long = calendar.where(F.col("months") == 12).unpivot([*keys, "year"], cols, "_c", "excess")
    return (long.groupBy(*keys, F.substring("_c", 4, 64).alias("benchmark"))
            .agg(F.avg(F.coalesce((F.col("excess") > 0).cast("double"), F.lit(0.0))).alias("hit_rate")))


def rolling_excess(monthly: DataFrame, months: int, keys: Sequence[str] = (), strategy: str = "net",
                   benchmarks: Mapping[str, str] = BENCHMARK_LABELS) -> DataFrame:
    """Annualised return over the last ``months`` minus the benchmark's; full windows only."""
    base = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    w = base.rowsBetween(-(months - 1), 0)
    have = [c for c in benchmarks if c in monthly.columns]

    def annual(c: str):
        return F.when(F.count(c).over(w) == months, F.pow(F.product(1 + F.col(c)).over(w), F.lit(12.0 / months)) - 1)

    out = monthly.select(*keys, "date", *[(annual(strategy) - annual(c)).alias(c) for c in have])
    return out.dropna(how="all", subset=have)


def capm(monthly: DataFrame, keys: Sequence[str] = (), strategy: str = "net", market: str = "market_vw_return",
         rf: str = RF) -> DataFrame:
    """Regression of the strategy's excess return on the market's, with t-statistics in closed form."""
    y, x = F.col(strategy) - F.col(rf), F.col(market) - F.col(rf)
    sums = monthly.where(y.isNotNull() & x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.regr_slope(y, x).alias("_b"),
        F.regr_intercept(y, x).alias("_a"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
        F.regr_r2(y, x).alias("_r2"))
    return regression_figures(sums, keys)


def regression_figures(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficients and t-statistics from the sums of a regression; NULL under twelve months."""
    enough = F.col("n") >= 12
    s2 = F.col("_syy") * (1 - F.col("_r2")) / F.greatest(F.col("n") - 2, F.lit(1))
    se_b = F.sqrt(F.greatest(safe_div(s2, "_sxx"), F.lit(0.0)))
    se_a = F.sqrt(F.greatest(s2, F.lit(0.0)) * (1.0 / F.col("n") + safe_div(F.col("_mx") * F.col("_mx"), "_sxx")))
    return sums.select(*keys, F.when(enough, F.col("_a") * 12).alias("alpha_annual"),
                       F.when(enough, F.col("_b")).alias("beta"), F.when(enough, safe_div("_a", se_a)).alias("alpha_t"),
                       F.when(enough, safe_div("_b", se_b)).alias("beta_t"), F.when(enough, F.col("_r2")).alias("r2"), "n")


def turnover_stats(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    years = F.count(F.lit(1)) / 12
    return monthly.groupBy(*keys).agg(
        F.try_divide(F.coalesce(F.sum("turnover"), F.lit(0.0)), years).alias("avg_turnover_per_year"),
        (stats.cagr("gross") - stats.cagr("net")).alias("cost_drag_per_year"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost_paid"))


def headline(monthly: DataFrame, keys: Sequence[str] = (),
             benchmarks: Mapping[str, str] = BENCHMARK_LABELS) -> DataFrame:
    """The figures a report starts with, one row per run, in one aggregation."""
    have = [c for c in benchmarks if c in monthly.columns]
    years = F.count(F.lit(1)) / 12
    return monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"), stats.cagr("net").alias("cagr_net"), stats.cagr("gross").alias("cagr_gross"),
        stats.ann_vol("net").alias("ann_vol"), stats.sharpe("net", RF).alias("sharpe"),
        F.try_divide(F.coalesce(F.sum("turnover"), F.lit(0.0)), years).alias("avg_turnover_per_year"),
        (stats.cagr("gross") - stats.cagr("net")).alias("cost_drag_per_year"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost_paid"),
        *[e for c in have for e in (stats.cagr(c).alias(f"cagr_{c}"),
                                    stats.excess_cagr("net", c).alias(f"excess_vs_{c}"),
                                    stats.t_stat_excess("net", c).alias(f"t_vs_{c}"))])


def period_report(monthly: DataFrame, split_date: str | None, keys: Sequence[str] = ()) -> DataFrame:
    """Headline excess per period; periods shorter than a year are left out."""
    group = [*keys, "period"]
    return (split_periods(monthly, split_date).groupBy(*group).agg(
        F.count(F.lit(1)).alias("months"), stats.excess_cagr("net", "universe_ew").alias("headline_excess"),
        stats.t_stat_excess("net", "universe_ew").alias("t_vs_universe_ew"))
        .where(F.col("months") >= 12))
