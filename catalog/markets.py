"""Two markets in one job: deciles, supplied scores, and every table of a run's report."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from pitrank.analytics.deciles import decile_returns, decile_scored
from pitrank.analytics.report import run_report
from pitrank.plans.backtest import run_backtest, run_scores

from .common import ORACLES, present, register
from .core import SPEC
from .portfolios import ANNUAL, MARKETS_LAYOUT, SUPPLIED_LAYOUT, two_markets, two_markets_sql
from .reports import CAL_LAYOUT, CAPM_LAYOUT, HEAD_LAYOUT, PERIOD_LAYOUT, SUM_LAYOUT

MARKET = ["panel_id"]


@register("p16_deciles_many_markets_annual", two_markets_sql(ORACLES["p16_deciles_at_finer_cadence"]))
def p16_annual(spark, sf):
    """An annual strategy: deciles come from a quarterly ranking of both markets."""
    return present(decile_returns(decile_scored(two_markets(spark, sf), ANNUAL, panel_keys=MARKET)), MARKETS_LAYOUT)


@register("p14_scores_many_markets", two_markets_sql(ORACLES["p14_supplied_scores"]))
def p14_markets(spark, sf):
    both = two_markets(spark, sf, filings=False)
    ahead = F.lead("total_return").over(Window.partitionBy(*MARKET, "security_id").orderBy("date"))
    scores = both.returns.select(*MARKET, "security_id", "date", ahead.alias("score"))
    return present(run_scores(both, scores, SPEC, panel_keys=MARKET), "panel_id:i " + SUPPLIED_LAYOUT)


def report(spark, sf):
    both = two_markets(spark, sf)
    return run_report(run_backtest(both, SPEC, panel_keys=MARKET), both)


def table_of(name: str, oracle: str, part: str, layout: str, where: str = "true"):
    @register(name, two_markets_sql(ORACLES[oracle]))
    def query(spark, sf):
        return present(report(spark, sf)[part].where(where), "panel_id:i " + layout)
    query.__doc__ = f"The report's table {part!r} for two markets."


table_of("a17_report_headline", "a09_a10_a17_headline", "headline", HEAD_LAYOUT)
table_of("a17_report_periods", "f05_f06_periods", "periods", PERIOD_LAYOUT)
table_of("a17_report_summary", "a05_a12_summary_table", "summary", SUM_LAYOUT, "period = 'full'")
table_of("a17_report_calendar", "a13_calendar_years", "calendar", CAL_LAYOUT)
table_of("a17_report_hit_rates", "a14_f07_hit_rates", "hit_rates", "benchmark hit_rate:8")
table_of("a17_report_capm", "a15_capm", "capm", CAPM_LAYOUT)
table_of("a17_report_deciles", "a18_decile_table", "deciles", "decile:i cagr:8 excess:8 t:7")
