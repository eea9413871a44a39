import pytest
from pyspark.sql import functions as F

from helpers import d, fundamentals_df, month_ends, returns_df, rows
from pitrank.analytics.runlog import append_log, count_runs, latest_runs, log_rows, read_log
from pitrank.audits import contract as C
from pitrank.audits.leakage import backfilled_quarters, quarter_gaps, restatements
from pitrank.functions.lineage import materialize, shared_folder
from pitrank.operators.universe import UniverseRule
from pitrank.plans.backtest import holdings_at, run_backtest, top_of_ranking
from pitrank.plans.spec import BacktestSpec
from pitrank.schemas import BENCHMARKS, RETURNS
from pitrank.sources.canonical import Panel, clean_nan, prepare_panel, read_panel
from pitrank.sources.sinks import read_null_runs, write_canonical, write_null_runs, write_result, write_table

META = dict(name="x", display_name="x", coverage_start="", coverage_end="", is_simulated=False, survivorship_bias=False, caveats=[])


def dummy(spark):
    """A and B live 24 months, C is delisted in month 18; eight quarters each, published after 60 days."""
    import datetime as dt
    me = month_ends("2019-01", 24)
    r = [(s, m, 0.01 * (1 + "ABC".index(s)) + (i % 3) / 100, 10.0 + i, 1e7, None, None, None, s == "C" and i == 17)
         for s in "ABC" for i, m in enumerate(me) if s != "C" or i < 18]
    f = [(s, e, e + dt.timedelta(days=60), 1e6 * ("ABC".index(s) + 1) * (k + 1)) for s in "ABC" for k, e in enumerate(month_ends("2018-01", 24)[2::3])]
    b = spark.createDataFrame([(m, 0.01, 0.01, 0.01, 0.001) for m in me], BENCHMARKS)
    return Panel(returns_df(spark, r), fundamentals_df(spark, f), b)


def test_contract(spark):
    p = dummy(spark)
    assert C.check_contract(p, META) == {"returns": 66, "fundamentals": 24, "benchmarks": 24}
    with pytest.raises(KeyError):
        C.check_contract(p, {"name": "x"})
    with pytest.raises(C.ContractError, match="unique_key"):
        C.check_contract(Panel(p.returns.unionByName(p.returns), p.fundamentals, p.benchmarks), META)
    with pytest.raises(C.ContractError, match="published_after_period"):
        C.check_contract(Panel(p.returns, p.fundamentals.withColumn("available_date", F.date_sub("fiscal_period_end", 1)), p.benchmarks), META)
    with pytest.raises(C.ContractError, match="price"):
        C.check_contract(Panel(p.returns.drop("price"), p.fundamentals, p.benchmarks), META)
    assert C.schema_problems(p.returns.withColumn("price", F.lit("x")), RETURNS) == ["price: string instead of double"]
    wrong = p.returns.withColumn("is_delisted_this_month", (F.col("security_id") == "C") & (F.month("date") == 3))
    assert {r["rule"]: r["violations"] for r in rows(C.returns_violations(wrong))} == {"month_end": 0, "unique_key": 0, "one_delisting": 1, "delisting_is_last": 1}
    tables = C.expected_columns(spark, {"t": p.benchmarks}, {"t": ["date", "nothing"], "u": ["a"]})
    got = {(r["table_name"], r["column_name"]): (r["found"], r["note"]) for r in rows(tables)}
    assert got[("t", "date")][0] and not got[("t", "nothing")][0] and got[("u", "*")][1] == "table not found" and "risk_free_rate" in got[("t", "(others)")][1]


def test_nan_never_enters(spark):
    df = clean_nan(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, y string"))
    assert [r["x"] for r in rows(df, "y")] == [None, 1.0]


def test_backtest_sinks_and_log(spark, tmp_path):
    p = dummy(spark)
    spec = BacktestSpec(start="2019-03-31", end="2020-12-31", frequency="quarterly", anchor_month=12, top_n=1, factors={"earnings_yield": 1.0},
                        universe=UniverseRule(min_market_cap=0.0))
    res = run_backtest(p, spec, check=True)
    stats = rows(res.universe_stats, "formation_date")
    assert stats[0]["n_alive"] == 3 and stats[-1]["n_alive"] == 2 and all(s["n_dropped_missing"] == s["n_universe"] - s["n_ranked"] for s in stats)
    assert holdings_at(res, "2019-12-31").count() == 1 and top_of_ranking(res, "2019-12-31").count() == 3
    m = rows(res.monthly, "date")
    assert m[0]["date"] == d("2019-04-30") and m[0]["turnover"] == 0.5 and m[0]["cost"] > 0 and len(m) == 21
    with pytest.raises(ValueError):
        run_backtest(p, BacktestSpec(start="2020-06-30", end="2020-12-31", factors={"earnings_yield": 1.0}), check=True)
    paths = write_result(res, str(tmp_path / "out"))
    write_result(res, str(tmp_path / "csv"), "r1", "csv")
    write_table(res.monthly.limit(1), str(tmp_path / "calendar"), "r1")
    back = spark.read.parquet(paths["monthly"])
    assert back.count() == 21 and back.select("run_id").distinct().first()[0] == spec.key()
    assert (tmp_path / "csv" / "holdings" / "run_id=r1").exists()
    target = write_canonical(p.returns, str(tmp_path / "tables"), "returns", spec.as_dict(), "date")
    assert spec.key() in target and spark.read.parquet(target).where("year = 2019").count() == 36
    head = spark.createDataFrame([(0.1, 1.0, 0.02)], "cagr_net double, sharpe double, excess_vs_universe_ew double")
    log = str(tmp_path / "log")
    append_log(log_rows(head, spec, "dummy"), log)
    append_log(log_rows(head, spec, "dummy"), log)
    append_log(log_rows(head, BacktestSpec(top_n=2, factors={"roe": 1.0}), "dummy"), log)
    got = read_log(spark, log)
    assert count_runs(got).first().asDict() == {"n_runs": 3, "n_trials": 2} and latest_runs(got, 2).count() == 2
    assert got.where("config.factors['earnings_yield'] = 1.0").count() == 2
    runs = spark.createDataFrame([(1, 0.5)], "panel_id int, sharpe double")
    for batch in ("a", "b", "b"):
        write_null_runs(runs, str(tmp_path / "null"), batch)
    assert read_null_runs(spark, str(tmp_path / "null"), runs.schema).count() == 2
    p.returns.write.parquet(str(tmp_path / "panel" / "returns"))
    p.fundamentals.write.parquet(str(tmp_path / "panel" / "fundamentals"))
    p.benchmarks.write.parquet(str(tmp_path / "panel" / "benchmarks"))
    cut = prepare_panel(read_panel(spark, str(tmp_path / "panel")), "2020-06-30", "2020-12-31")
    assert str(cut.returns.agg(F.min("date")).first()[0]) == "2019-05-31" and cut.benchmarks.count() == 7
    plan = cut.returns.select("date")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2019-05-30)" in plan and "ReadSchema: struct<date:date>" in plan


def test_shared_folder(spark):
    class Named:
        class conf:
            get = staticmethod(lambda key, default: "hdfs://shared/tmp/" if key == "spark.checkpoint.dir" else default)
    assert shared_folder(Named) == "hdfs://shared/tmp"
    df = materialize(spark.range(10).toDF("x"))
    assert df.count() == 10 and len(df.inputFiles()) > 0


def test_gap_and_restatement_audits(spark):
    rows_ = [("A", d(e), d(a), v) for e, a, v in (("2020-03-31", "2020-05-01", 1), ("2020-06-30", "2020-08-01", 2), ("2020-12-31", "2021-02-01", -4),
                                                  ("2020-06-30", "2020-09-01", 3))]
    f = fundamentals_df(spark, rows_)
    filled = rows(backfilled_quarters(f))
    assert len(filled) == 1 and str(filled[0]["fiscal_period_end"]) == "2020-09-30" and str(filled[0]["available_date"]) == "2020-11-29" and filled[0]["ebit_ttm"] == -4.0
    gaps = {r["distressed"]: r for r in rows(quarter_gaps(f))}
    assert gaps[True]["n_gaps"] == 1 and gaps[False]["n_gaps"] == 0 and gaps[False]["n"] == 2
    got = restatements(f).first()
    assert (got.n_rows, got.n_restated_rows, got.n_not_later) == (4, 2, 0)
