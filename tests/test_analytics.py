import math

from pyspark.sql import functions as F

from helpers import approx, d, month_ends, rows
from pitrank.analytics import metrics as M
from pitrank.analytics.deciles import decile_assignments, decile_summary, decile_table
from pitrank.analytics.nulls import null_summary, null_values, oracle_fraction, placement, multiple_testing_bar
from pitrank.analytics.verdict import verdict
from pitrank.functions import stats


def series(spark, values, start="2000-01"):
    return spark.createDataFrame([(m, v) for m, v in zip(month_ends(start, len(values)), values)], "date date, r double")


def agg(df, **cols):
    return df.agg(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_growth_and_risk(spark):
    got = agg(series(spark, [0.01] * 24), cagr=stats.cagr("r"), vol=stats.ann_vol("r"), sh=stats.sharpe("r", F.lit(0.0)))
    assert approx(got["cagr"], 1.01 ** 12 - 1) and approx(got["vol"], 0.0, 1e-12)
    got = agg(series(spark, [0.5, -1.0, 0.2]), cagr=stats.cagr("r"))
    assert got["cagr"] == -1.0
    got = agg(series(spark, [None, None]), cagr=stats.cagr("r"), vol=stats.ann_vol("r"))
    assert got == {"cagr": None, "vol": None}
    x = [0.03, -0.01] * 12
    got = agg(series(spark, x), sh=stats.sharpe("r", F.lit(0.0)), so=stats.sortino("r", F.lit(0.0)))
    sd = math.sqrt(24 * 0.02 ** 2 / 23)
    assert approx(got["sh"], 0.01 / sd * math.sqrt(12)) and approx(got["so"], 0.01 / math.sqrt(0.0001 / 2) * math.sqrt(12))
    two = series(spark, x).withColumn("b", F.when(F.col("date") > F.lit("2000-06-30").cast("date"), F.col("r") - 0.01))
    got = agg(two, e=stats.excess_cagr("r", "b"), t=stats.t_stat_excess("r", F.lit(0.0)))
    r18, b18 = 1.0, 1.0
    for v in x[6:]:
        r18, b18 = r18 * (1 + v), b18 * (0.99 + v)
    assert approx(got["e"], r18 ** (12 / 18) - b18 ** (12 / 18)) and approx(got["t"], 0.01 / sd * math.sqrt(24))


def drawdown(spark, values):
    return M.max_drawdowns(series(spark, values).withColumn("series", F.lit("s")), ["series"]).first()


def test_drawdowns(spark):
    a = drawdown(spark, [0.10, -0.20, 0.05, 0.30, 0.01])
    assert approx(a.max_drawdown, -0.2) and a.recovered and a.duration_months == 3
    assert (a.peak, a.trough, a.recovery) == (d("2000-01-31"), d("2000-02-29"), d("2000-04-30"))
    b = drawdown(spark, [0.10, -0.30, 0.01, 0.01])
    assert not b.recovered and b.recovery is None and b.duration_months == 3
    c = drawdown(spark, [0.01, 0.02])
    assert c.max_drawdown == 0 and c.peak == c.trough == c.recovery == d("2000-01-31") and c.duration_months == 0


def monthly(spark, n=24, run="a"):
    ms = month_ends("2000-01", n)
    return spark.createDataFrame([(run, m, 0.02, 0.021, 0.01, 0.03, 0.0, None if i < 3 else 0.01, 0.001, 0.5 if i % 12 == 0 else None, 0.001)
                                  for i, m in enumerate(ms)],
                                 "run_id string, date date, net double, gross double, universe_ew double, market_ew_return double, market_vw_return double, "
                                 "sp500_total_return double, risk_free_rate double, turnover double, cost double")


def test_calendar_hits_rolling_periods(spark):
    m = monthly(spark)
    cal = rows(M.calendar_years(m), "year")
    assert [r["months"] for r in cal] == [12, 12] and approx(cal[0]["strategy"], 1.02 ** 12 - 1)
    assert approx(cal[0]["sp500_total_return"], 1.01 ** 9 - 1) and approx(cal[1]["vs_universe_ew"], 1.02 ** 12 - 1.01 ** 12)
    hits = {r["benchmark"]: r["hit_rate"] for r in rows(M.hit_rates(M.calendar_years(m)))}
    assert hits == {"universe_ew": 1.0, "market_ew_return": 0.0, "market_vw_return": 1.0, "sp500_total_return": 1.0}
    roll = rows(M.rolling_excess(m, 12), "date")
    assert len(roll) == 13 and approx(roll[0]["universe_ew"], 1.02 ** 12 - 1.01 ** 12) and roll[0]["sp500_total_return"] is None
    per = {r["period"]: r for r in rows(M.period_report(m, "2000-12-31"))}
    assert set(per) == {"full", "in", "out"} and per["in"]["months"] == 12
    assert set(r["period"] for r in rows(M.period_report(m, "2000-06-30"))) == {"full", "out"}     # six months are too few
    t = rows(M.turnover_stats(m))[0]
    assert approx(t["avg_turnover_per_year"], 0.5) and approx(t["total_cost_paid"], 0.024)
    both = m.unionByName(monthly(spark, 24, "b").withColumn("net", F.lit(0.01)))
    head = {r["run_id"]: r for r in rows(M.headline(both, ["run_id"]))}
    assert approx(head["a"]["excess_vs_universe_ew"], 1.02 ** 12 - 1.01 ** 12) and approx(head["b"]["excess_vs_universe_ew"], 0.0, 1e-12)
    assert M.summary_table(both, ["run_id"]).count() == 12


def test_capm_recovers_exact_coefficients(spark):
    ms = month_ends("2000-01", 240)
    data = [(m, 0.003 + 1.5 * math.sin(i) / 20 + 0.001, math.sin(i) / 20 + 0.001, 0.001) for i, m in enumerate(ms)]
    m = spark.createDataFrame(data, "date date, net double, market_vw_return double, risk_free_rate double")
    got = M.capm(m).first()
    assert approx(got.alpha_annual, 0.036, 1e-9) and approx(got.beta, 1.5, 1e-9) and approx(got.r2, 1.0, 1e-9) and got.n == 240
    few = M.capm(m.limit(11)).first()
    assert few.beta is None and few.n == 11


def test_luck(spark):
    runs = spark.createDataFrame([(i, i / 100) for i in range(1, 101)], "panel_id int, excess_vs_universe_ew double")
    s = null_summary(v := null_values(runs, metrics=["excess_vs_universe_ew"]))
    row = s.first()
    assert row.n == 100 and approx(row.p50, 0.505) and approx(row.p95, 0.9505)
    probes = spark.createDataFrame([(1, "excess_vs_universe_ew", 0.955), (2, "excess_vs_universe_ew", 0.5), (3, "excess_vs_universe_ew", None),
                                    (4, "excess_vs_universe_ew", 2.0), (5, "excess_vs_universe_ew", 0.905)], "run_id int, metric string, value double")
    got = {r["run_id"]: r for r in rows(placement(probes, v))}
    assert got[1]["percentile"] == 95.0 and got[1]["verdict"] == "p95" and got[2]["verdict"] == "inside"
    assert got[3]["available"] is False and got[3]["verdict"] is None and got[4]["verdict"] == "p99" and got[5]["verdict"] == "p90"
    bar = {r["n_trials"]: r for r in rows(multiple_testing_bar(spark.createDataFrame([(1,), (9,)], "n_trials int"), v))}
    assert approx(bar[1]["expected_best_of_n"], 0.505) and approx(bar[1]["significance_bar"], 0.9505) and approx(bar[9]["expected_best_of_n"], 0.01 + 0.9 * 0.99)
    assert bar[9]["significance_bar"] > bar[1]["significance_bar"]
    m = spark.createDataFrame([("a", x, 0.02, 0.03, 0.01) for x in month_ends("2000-01", 12)] + [("b", x, 0.02, 0.0102, 0.01) for x in month_ends("2000-01", 12)],
                              "run_id string, date date, net double, oracle_net double, universe_ew double")
    frac = {r["run_id"]: r["fraction_of_oracle"] for r in rows(oracle_fraction(m, ["run_id"]))}
    assert approx(frac["a"], (1.02 ** 12 - 1.01 ** 12) / (1.03 ** 12 - 1.01 ** 12)) and frac["b"] is None


def test_deciles(spark):
    ranks = spark.createDataFrame([(d("2000-01-31"), 0, f"S{i}", i) for i in range(1, 26)], "formation_date date, sleeve int, security_id string, rank long")
    by = {r["rank"]: r["decile"] for r in rows(decile_assignments(ranks))}
    assert by[1] == 10 and by[25] == 1 and by[2] == 10 and by[3] == 9
    ms = month_ends("2000-01", 12)
    dr = spark.createDataFrame([(k, m, k / 1000 + (i % 3) / 500) for k in range(1, 11) for i, m in enumerate(ms)], "decile int, date date, gross double")
    uni = spark.createDataFrame([(m, 0.005) for m in ms], "date date, universe_ew double")
    table = decile_table(dr, uni)
    got = decile_summary(dr, table).first()
    assert approx(got.spearman, 1.0) and got.monotone_steps == 9 and got.top_is_best and got.top_minus_bottom_annual > 0


def test_verdict(spark):
    cols = ("run_id string, excess_vs_universe_ew double, t_vs_universe_ew double, null_percentile double, top_minus_bottom_t double, top_is_best boolean, "
            "excess_in double, excess_out double, fraction_of_oracle double, cost_drag_per_year double")
    df = spark.createDataFrame([("good", 0.03, 2.5, 97.0, 2.5, True, 0.02, 0.01, 0.9, 0.002), ("bad", -0.01, -0.5, 40.0, 0.5, False, 0.02, -0.01, 1.6, 0.02),
                                ("part", 0.01, 1.0, None, 1.5, True, None, None, None, 0.0)], cols)
    got = {(r["run_id"], r["question"]): r["status"] for r in rows(verdict(df))}
    assert [got[("good", q)] for q in ("beats_universe", "luck", "deciles", "out_of_sample", "signal_captured", "trading_costs")] == ["good"] * 5 + ["info"]
    assert [got[("bad", q)] for q in ("beats_universe", "luck", "deciles", "out_of_sample", "signal_captured", "trading_costs")] == ["bad", "bad", "bad", "warn", "bad", "warn"]
    assert got[("part", "beats_universe")] == "warn" and ("part", "luck") not in got and got[("part", "deciles")] == "warn"
