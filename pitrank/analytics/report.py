"""All report tables of one backtest, for one market or many.

Figures of months, periods and years are grouping sets of one aggregation over (series, month) rows; the tables a reader
knows are cuts of it. Only what needs months in order (drawdowns, rolling windows) reads the monthly table again.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import stats
from ..functions.lineage import materialize
from ..plans.backtest import BacktestResult, run_scores
from ..schemas import BENCHMARK_LABELS
from ..sources.canonical import Panel
from . import metrics as M
from .deciles import decile_returns, decile_scored, decile_summary, decile_table
from .nulls import multiple_testing_bar, oracle_fraction, placement
from .verdict import verdict

RUN = ["run_id"]
FULL, FIRST, SECOND = "full", "in", "out"


def report_measures(monthly: DataFrame, split_date: str | None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, series, period or year, and every figure of that series over it.

    A row has either a ``period`` (full, in or out) or a ``year``. ``excess`` and ``t`` compare the strategy's net return
    with the series, ``alpha_annual`` to ``r2`` regress it on the series. Partial sums leave a task, so the shuffle grows
    with runs and years, not with months.
    """
    keys = list(keys)
    series = [c for c in M.SERIES if c in monthly.columns]
    half = (F.when(F.col("date") <= F.lit(split_date).cast("date"), FIRST).otherwise(SECOND) if split_date
            else F.lit(None).cast("string"))
    long = monthly.select(
        *keys, F.year("date").alias("year"), half.alias("half"), F.col("net").alias("s"), F.col(M.RF).alias("rf"), "turnover",
        "cost", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("r")) for c in series])).alias("_x"))
    long = long.select(*[c for c in long.columns if c != "_x"], "_x.*")
    s, r, rf = F.col("s"), F.col("r"), F.col("rf")
    by = [*keys, "series"]
    made = (long.groupingSets([by, [*by, "half"], [*by, "year"]], *by, "half", "year").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("months"), F.count(r).alias("n"), stats.cagr(r).alias("cagr"),
        stats.ann_vol(r).alias("ann_vol"), stats.sharpe(r, rf).alias("sharpe"), stats.sortino(r, rf).alias("sortino"),
        F.max(r).alias("best_month"), F.min(r).alias("worst_month"),
        (F.coalesce(F.product(1 + r), F.lit(1.0)) - 1).alias("growth"), stats.excess_cagr(s, r).alias("excess"),
        stats.t_stat_excess(s, r).alias("t"), F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost_paid"), *_regression(s - rf, r - rf)))
    # grouping_id has a bit per column, the last column lowest: 3 both rolled up, 1 the year only, 2 the half only
    period = F.when(F.col("_set") == 3, FULL).when(F.col("_set") == 1, F.col("half"))
    return (made.withColumn("period", period).where(F.col("period").isNotNull() | (F.col("_set") == 2))
            .select(*by, "period", "year", *[c for c in made.columns if c not in (*by, "half", "year", "_set")]))


def _regression(y: Column, x: Column) -> list[Column]:
    """Sums of the closed form; months where one is missing do not count."""
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y), F.when(both, x)
    return [F.count(x).alias("_n"), F.avg(x).alias("_mx"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"),
            F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_r2(y, x).alias("_r2")]


def _of(series: str, column: str) -> Column:
    return F.max(F.when(F.col("series") == series, F.col(column)))


# benchmarks in report order; those that a monthly table lacks have no rows and give NULL
BENCHMARKS = list(BENCHMARK_LABELS)


def headline_of(measures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The figures a report starts with, one row per run."""
    years = _of("net", "months") / 12
    return measures.where(F.col("period") == FULL).groupBy(*keys).agg(
        _of("net", "months").alias("months"), _of("net", "cagr").alias("cagr_net"), _of("gross", "cagr").alias("cagr_gross"),
        _of("net", "ann_vol").alias("ann_vol"), _of("net", "sharpe").alias("sharpe"),
        F.try_divide(_of("net", "turnover"), years).alias("avg_turnover_per_year"),
        (_of("gross", "cagr") - _of("net", "cagr")).alias("cost_drag_per_year"),
        _of("net", "total_cost_paid").alias("total_cost_paid"),
        *[e for c in BENCHMARKS for e in (_of(c, "cagr").alias(f"cagr_{c}"), _of(c, "excess").alias(f"excess_vs_{c}"),
                                                     _of(c, "t").alias(f"t_vs_{c}"))])


def periods_of(measures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Headline excess per period; periods shorter than a year are left out."""
    return (measures.where((F.col("series") == "universe_ew") & F.col("period").isNotNull() & (F.col("months") >= 12))
            .select(*keys, "period", "months", F.col("excess").alias("headline_excess"), F.col("t").alias("t_vs_universe_ew")))


def summary_of(measures: DataFrame, drawdowns: DataFrame, keys: Sequence[str] = (),
               series: Mapping[str, str] = M.SERIES) -> DataFrame:
    """Growth, risk, drawdown and extremes of every series per period of a year or more."""
    label = F.create_map(*[F.lit(x) for kv in series.items() for x in kv])[F.col("series")]
    rows = (measures.where(F.col("period").isNotNull() & (F.col("months") >= 12)).withColumn("series", label)
            .select(*keys, "period", "series", "cagr", "ann_vol", "sharpe", "sortino", "best_month", "worst_month", "months"))
    dd = drawdowns.select(*keys, "period", "series", "max_drawdown", F.col("duration_months").alias("drawdown_months"))
    return rows.join(dd, [*keys, "period", "series"])


def calendar_of(measures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Compounded return per calendar year, excess over each benchmark, number of months."""
    have = BENCHMARKS
    out = measures.where(F.col("year").isNotNull()).groupBy(*keys, "year").agg(
        _of("net", "growth").alias("strategy"), *[_of(c, "growth").alias(c) for c in have], _of("net", "n").alias("months"))
    return out.withColumns({f"vs_{c}": F.col("strategy") - F.col(c) for c in have})


def capm_of(measures: DataFrame, keys: Sequence[str] = (), market: str = "market_vw_return") -> DataFrame:
    """Regression on the market per period of a year or more, with t-statistics in closed form."""
    rows = measures.where((F.col("series") == market) & F.col("period").isNotNull() & (F.col("months") >= 12))
    return M.regression_figures(rows.withColumn("n", F.col("_n")), [*keys, "period"])


def run_report(result: BacktestResult, panel: Panel, null: DataFrame | None = None, bound_scores: DataFrame | None = None,
               trials: DataFrame | None = None, decile_frequency: str = "quarterly") -> dict[str, DataFrame]:
    """Name -> table. ``null``: metric, value of luck runs; ``bound_scores``: security_id, date, score of an upper bound;
    ``trials``: one row with ``n_trials`` from the run log. Parts without their input are left out.

    Markets that the result tells apart are told apart in every table, and ``bound_scores`` carries their keys. The monthly
    table and its figures, a few hundred rows per run, are written once; every table is cut from them.
    """
    spec, markets = result.spec, list(result.scored.panel_keys)
    run, keys = F.lit(spec.key()), [*RUN, *markets]
    m = materialize(result.monthly.withColumn("run_id", run))
    figures = materialize(report_measures(m, spec.split_date, keys))
    head, long_enough, calendar = headline_of(figures, keys), periods_of(figures, keys), calendar_of(figures, keys)
    by_period = [*keys, "period"]
    kept = M.split_periods(m, spec.split_date).join(long_enough.select(*by_period), by_period, "left_semi")
    drawdowns = M.max_drawdowns(M.series_long(kept, M.SERIES, by_period), [*by_period, "series"])
    market_line = capm_of(figures, keys)
    out = {"monthly": m, "headline": head, "periods": long_enough, "summary": summary_of(figures, drawdowns, keys),
           "period_capm": market_line, "calendar": calendar, "hit_rates": M.hit_rates(calendar, keys),
           "rolling_3y": M.rolling_excess(m, 36, keys), "rolling_5y": M.rolling_excess(m, 60, keys),
           "capm": market_line.where(F.col("period") == FULL).drop("period")}
    sides = long_enough.groupBy(*keys).agg(*[F.max(F.when(F.col("period") == p, F.col("headline_excess"))).alias(f"excess_{p}")
                                             for p in (FIRST, SECOND)])
    scored = decile_scored(panel, spec, result.scored, decile_frequency)
    returns = materialize(decile_returns(scored).withColumn("run_id", run))
    out["decile_returns"] = returns
    out["deciles"] = decile_table(returns, m, keys)
    out["decile_summary"] = decile_summary(returns, out["deciles"], keys)
    row = head.join(sides, keys, "left").join(out["decile_summary"], keys, "left")
    if null is not None:
        probe = head.select(*keys, F.lit("excess_vs_universe_ew").alias("metric"), F.col("excess_vs_universe_ew").alias("value"))
        out["null"] = placement(probe, null, keys)
        row = row.join(out["null"].select(*keys, F.col("percentile").alias("null_percentile")), keys, "left")
        if trials is not None:
            out["testing_bar"] = multiple_testing_bar(trials, null)
    if bound_scores is not None:
        bound = (run_scores(panel, bound_scores, spec, panel_keys=markets)
                 .select(*markets, "date", F.col("net").alias("oracle_net"), F.col("universe_ew").alias("bound_universe")))
        both = (m.join(bound, [*markets, "date"])
                .select(*keys, "date", "net", "oracle_net", F.col("bound_universe").alias("universe_ew")))
        out["oracle"] = oracle_fraction(both, keys)
        row = row.join(out["oracle"].select(*keys, "fraction_of_oracle"), keys, "left")
    out["verdict"] = verdict(row, keys)
    return out
