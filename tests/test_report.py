from dataclasses import replace

from conftest import SF
from helpers import approx, rows
from catalog.core import SPEC as BASE
from catalog.panel import panel
from catalog.portfolios import hindsight
from pitrank.analytics.nulls import null_values
from pitrank.analytics.report import run_report
from pitrank.audits.contract import expected_columns
from pitrank.plans.backtest import run_backtest
from pitrank.vendor.expected import EXPECTED_TABLES


SPEC = replace(BASE, top_n=1)


def test_run_report(spark):
    p = panel(spark, SF)
    null = null_values(spark.createDataFrame([(i, i / 1000 - 0.05) for i in range(100)], "panel_id int, excess_vs_universe_ew double"),
                        metrics=["excess_vs_universe_ew"])
    rep = run_report(run_backtest(p, SPEC), p, null, hindsight(spark, SF), spark.createDataFrame([(3,)], "n_trials int"))
    head = rows(rep["headline"])[0]
    assert head["months"] == 60 and approx(head["cost_drag_per_year"], head["cagr_gross"] - head["cagr_net"])
    assert {r["period"] for r in rows(rep["periods"])} == {"full", "in", "out"}
    assert rep["summary"].count() == 18 and rep["period_capm"].count() == 3 and rep["rolling_3y"].count() == 25
    assert rows(rep["testing_bar"])[0]["available"] and rows(rep["null"])[0]["percentile"] is not None
    assert rows(rep["oracle"])[0]["excess_oracle"] > rows(rep["oracle"])[0]["excess_strategy"]
    got = {r["question"] for r in rows(rep["verdict"])}
    assert {"beats_universe", "luck", "out_of_sample", "signal_captured", "trading_costs"} <= got


def test_expected_vendor_tables(spark):
    have = spark.createDataFrame([], "permno long, DLSTDT date, dlret double, extra int")
    got = rows(expected_columns(spark, {"crsp.msedelist": have}, {k: EXPECTED_TABLES[k] for k in ("crsp.msedelist", "crsp.msi")}))
    assert {(r["column_name"], r["found"]) for r in got if r["table_name"] == "crsp.msedelist" and r["expected"]} == {
        ("permno", True), ("dlstdt", True), ("dlret", True), ("dlstcd", False)}
    assert [r["note"] for r in got if r["table_name"] == "crsp.msi"] == ["table not found"]
