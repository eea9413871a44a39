"""Performance reports on the monthly result of one backtest, panel descriptions and reference benchmarks."""
from __future__ import annotations

from pyspark.sql import functions as F

from pitrank.analytics import metrics as M
from pitrank.analytics import profile as P
from pitrank.analytics.deciles import decile_returns, decile_summary, decile_table
from pitrank.analytics.verdict import verdict
from pitrank.functions.lineage import materialize
from pitrank.plans.backtest import run_backtest
from pitrank.schemas import BENCHMARK_LABELS
from pitrank.vendor.market import market_returns, top_k_index

from .common import present, register, sql
from .core import SPEC
from .panel import BENCH_SQL, FUND_SQL, RET_SQL, fundamentals, panel, returns
from .portfolios import DEC_SUM, DEC_TABLE, DECILES, RUN, cagr_sql, excess_sql, t_sql

BENCHES = list(BENCHMARK_LABELS)
# Fixed values, written out for the SQL side: series of a monthly result and their labels.
SERIES = {"net": "Strategy (net)", "gross": "Strategy (gross)", "universe_ew": "EW universe", "market_ew_return": "EW market",
          "market_vw_return": "VW market", "sp500_total_return": "S&P 500"}
LONG = "\nlng AS (" + " UNION ALL ".join(
    f"SELECT date, risk_free_rate AS rf, '{v}' AS series, {k} AS r FROM monthly" for k, v in SERIES.items()) + ")"


def monthly(spark, sf):
    return materialize(run_backtest(panel(spark, sf), SPEC).monthly)


WEALTH = """
wl AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY series ORDER BY date) AS wealth FROM lng),
wp AS (SELECT *, max(wealth) OVER (PARTITION BY series ORDER BY date) AS peak_wealth FROM wl),
wd AS (SELECT *, wealth / peak_wealth - 1 AS drawdown FROM wp)"""
WEALTH_LAYOUT = "series date:d wealth:8 peak_wealth:8 drawdown:8"


@register("w12_w13_wealth_drawdown", sql(WEALTH_LAYOUT, "wd", *RUN, LONG, WEALTH))
def w12(spark, sf):
    return present(M.wealth_path(M.series_long(monthly(spark, sf), M.SERIES), ["series"]), WEALTH_LAYOUT)


DD_LAYOUT = "series max_drawdown:8 peak:d trough:d recovery:d duration_months:i recovered"
DD = """
tr AS (SELECT series, drawdown AS max_drawdown, date AS trough, peak_wealth AS pw FROM wd
       QUALIFY row_number() OVER (PARTITION BY series ORDER BY drawdown, date) = 1),
pk AS (SELECT series, wd.date AS peak FROM wd JOIN tr USING (series) WHERE wd.date <= trough
       QUALIFY row_number() OVER (PARTITION BY series ORDER BY wealth DESC, wd.date) = 1),
dd AS (SELECT tr.series, max_drawdown, peak, trough,
              (SELECT min(date) FROM wd WHERE wd.series = tr.series AND date >= trough AND wealth >= pw) AS recovery,
              (SELECT max(date) FROM wd WHERE wd.series = tr.series) AS last_date
       FROM tr JOIN pk USING (series)),
dds AS (SELECT *, recovery IS NOT NULL AS recovered, (year(coalesce(recovery, last_date)) - year(peak)) * 12
               + month(coalesce(recovery, last_date)) - month(peak) AS duration_months FROM dd)"""


@register("a11_max_drawdown", sql(DD_LAYOUT, "dds", *RUN, LONG, WEALTH, DD))
def a11(spark, sf):
    return present(M.max_drawdowns(M.series_long(monthly(spark, sf), M.SERIES), ["series"]), DD_LAYOUT)


SUM_LAYOUT = ("series cagr:8 ann_vol:8 sharpe:7 sortino:7 max_drawdown:8 drawdown_months:i best_month:9 worst_month:9")


@register("a05_a12_summary_table", sql(SUM_LAYOUT, "y", *RUN, LONG, WEALTH, DD, f"""
b AS (SELECT series, {cagr_sql('r')} AS cagr, stddev_samp(r) * sqrt(12) AS ann_vol,
             avg(r - rf) / nullif(stddev_samp(r - rf), 0) * sqrt(12) AS sharpe,
             avg(r - rf) / sqrt(avg(CASE WHEN r - rf IS NOT NULL THEN power(least(r - rf, 0), 2) END)) * sqrt(12) AS sortino,
             max(r) AS best_month, min(r) AS worst_month FROM lng GROUP BY series),
y AS (SELECT b.*, max_drawdown, duration_months AS drawdown_months FROM b JOIN dds USING (series))"""))
def a12(spark, sf):
    return present(M.summary_table(monthly(spark, sf)), SUM_LAYOUT)


CAL_LAYOUT = "year:i strategy:8 " + " ".join(f"{c}:8 vs_{c}:8" for c in BENCHES) + " months:i"
CAL = ("\ncal AS (SELECT year(date) AS year, product(1 + net) - 1 AS strategy, count(net) AS months, " + ", ".join(
    f"coalesce(product(1 + {c}), 1) - 1 AS {c}, product(1 + net) - coalesce(product(1 + {c}), 1) AS vs_{c}" for c in BENCHES)
    + " FROM monthly GROUP BY 1)")


@register("a13_calendar_years", sql(CAL_LAYOUT, "cal", *RUN, CAL))
def a13(spark, sf):
    return present(M.calendar_years(monthly(spark, sf)), CAL_LAYOUT)


@register("a14_f07_hit_rates", sql("benchmark hit_rate:8", "y", *RUN, CAL, "y AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS benchmark, avg((vs_{c} > 0)::INT) AS hit_rate FROM cal WHERE months = 12" for c in BENCHES) + ")"))
def a14(spark, sf):
    return present(M.hit_rates(M.calendar_years(monthly(spark, sf))), "benchmark hit_rate:8")


def rolling_sql(n: int) -> str:
    def ann(c):
        return (f"CASE WHEN count({c}) OVER w = {n} THEN power(product(1 + {c}) OVER w, 12.0::DOUBLE / {n}) - 1 END")
    return ("\nroll AS (SELECT date, " + ", ".join(f"({ann('net')}) - ({ann(c)}) AS {c}" for c in BENCHES)
            + f" FROM monthly WINDOW w AS (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),"
            "\nroll2 AS (SELECT * FROM roll WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in BENCHES) + ")")


ROLL_LAYOUT = "date:d " + " ".join(f"{c}:8" for c in BENCHES)
for _n, _label in ((12, "12"), (36, "36"), (60, "60")):
    def _roll(spark, sf, n=_n):
        return present(M.rolling_excess(monthly(spark, sf), n), ROLL_LAYOUT)
    register(f"w14_rolling_excess_{_label}", sql(ROLL_LAYOUT, "roll2", *RUN, rolling_sql(_n)))(_roll)

CAPM_LAYOUT = "alpha_annual:8 beta:8 alpha_t:7 beta_t:7 r2:8 n:i"


@register("a15_capm", sql(CAPM_LAYOUT, "y", *RUN, """
xy AS (SELECT net - risk_free_rate AS y, market_vw_return - risk_free_rate AS x FROM monthly
       WHERE net IS NOT NULL AND risk_free_rate IS NOT NULL AND market_vw_return IS NOT NULL),
co AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM xy),
rs AS (SELECT sum(power(y - a - b * x, 2)) AS sse, sum(power(y - my, 2)) AS sst, sum(power(x - mx, 2)) AS sxx FROM xy, co),
y AS (SELECT a * 12 AS alpha_annual, b AS beta, n, 1 - sse / sst AS r2, b / sqrt(sse / (n - 2) / sxx) AS beta_t,
             a / sqrt(sse / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx)) AS alpha_t FROM co, rs)"""))
def a15(spark, sf):
    return present(M.capm(monthly(spark, sf)), CAPM_LAYOUT)


TURN_LAYOUT = "avg_turnover_per_year:8 cost_drag_per_year:8 total_cost_paid:8"
TURN = (f"sum(turnover) / (count(*) / 12.0::DOUBLE) AS avg_turnover_per_year, ({cagr_sql('gross')}) - ({cagr_sql('net')}) "
        "AS cost_drag_per_year, sum(cost) AS total_cost_paid")


@register("a16_turnover_stats", sql(TURN_LAYOUT, "y", *RUN, f"y AS (SELECT {TURN} FROM monthly)"))
def a16(spark, sf):
    return present(M.turnover_stats(monthly(spark, sf)), TURN_LAYOUT)


HEAD_LAYOUT = ("months:i cagr_net:8 cagr_gross:8 ann_vol:8 sharpe:7 " + TURN_LAYOUT + " "
               + " ".join(f"cagr_{c}:8 excess_vs_{c}:8 t_vs_{c}:7" for c in BENCHES))
HEAD_COLS = (f"count(*) AS months, {cagr_sql('net')} AS cagr_net, {cagr_sql('gross')} AS cagr_gross, "
             f"stddev_samp(net) * sqrt(12) AS ann_vol, avg(net - risk_free_rate) / stddev_samp(net - risk_free_rate) * sqrt(12) AS sharpe, "
             f"{TURN}, " + ", ".join(f"{cagr_sql(c)} AS cagr_{c}, {excess_sql('net', c)} AS excess_vs_{c}, {t_sql('net', c)} AS t_vs_{c}"
                                     for c in BENCHES))


@register("a09_a10_a17_headline", sql(HEAD_LAYOUT, "y", *RUN, f"y AS (SELECT {HEAD_COLS} FROM monthly)"))
def a17(spark, sf):
    return present(M.headline(monthly(spark, sf)), HEAD_LAYOUT)


PERIOD_LAYOUT = "period months:i headline_excess:8 t_vs_universe_ew:7"


@register("f05_f06_periods", sql(PERIOD_LAYOUT, "y", *RUN, f"""
pm AS (SELECT 'full' AS period, * FROM monthly UNION ALL
       SELECT CASE WHEN date <= DATE '{SPEC.split_date}' THEN 'in' ELSE 'out' END, * FROM monthly),
y AS (SELECT period, count(*) AS months, {excess_sql('net', 'universe_ew')} AS headline_excess, {t_sql('net', 'universe_ew')} AS t_vs_universe_ew
      FROM pm GROUP BY period HAVING count(*) >= 12)"""))
def f05(spark, sf):
    return present(M.period_report(monthly(spark, sf), SPEC.split_date), PERIOD_LAYOUT)


@register("a27_verdict", sql("run_id:i question status", "y", *DECILES, DEC_TABLE, DEC_SUM.replace("\ny AS", "\ndboth AS"), f"""
h AS (SELECT {HEAD_COLS} FROM monthly),
pin AS (SELECT {excess_sql('net', 'universe_ew')} AS e FROM monthly WHERE date <= DATE '{SPEC.split_date}'),
pout AS (SELECT {excess_sql('net', 'universe_ew')} AS e FROM monthly WHERE date > DATE '{SPEC.split_date}'),
y AS (SELECT 1 AS run_id, 'beats_universe' AS question, CASE WHEN excess_vs_universe_ew > 0 AND t_vs_universe_ew >= 2 THEN 'good'
             WHEN excess_vs_universe_ew > 0 THEN 'warn' ELSE 'bad' END AS status FROM h
      UNION ALL SELECT 1, 'deciles', CASE WHEN top_minus_bottom_t >= 2 AND top_is_best THEN 'good' WHEN top_minus_bottom_t >= 1 THEN 'warn' ELSE 'bad' END FROM dboth
      UNION ALL SELECT 1, 'out_of_sample', CASE WHEN pin.e > 0 AND pout.e > 0 THEN 'good' WHEN pin.e > 0 THEN 'warn' ELSE 'info' END FROM pin, pout
      UNION ALL SELECT 1, 'trading_costs', CASE WHEN cost_drag_per_year < 0.01 THEN 'info' ELSE 'warn' END FROM h)"""))
def a27(spark, sf):
    res = run_backtest(panel(spark, sf), SPEC)
    m = materialize(res.monthly.withColumn("run_id", F.lit(1)))
    dr = decile_returns(res.scored).withColumn("run_id", F.lit(1))
    keys = ["run_id"]
    periods = M.period_report(m, SPEC.split_date, keys)
    sides = periods.groupBy("run_id").agg(*[F.max(F.when(F.col("period") == p, F.col("headline_excess"))).alias(f"excess_{p}")
                                            for p in ("in", "out")])
    dec = decile_summary(dr, decile_table(dr, m, keys), keys)
    report = M.headline(m, keys).join(sides, keys, "left").join(dec, keys, "left")
    return present(verdict(report), "run_id:i question status")


# ---------------------------------------------------------------- panel descriptions
@register("v22_v24_market_returns", sql("date:d market_vw_return:9 market_ew_return:9", "bench", RET_SQL, BENCH_SQL))
def v22(spark, sf):
    return present(market_returns(returns(spark, sf)), "date:d market_vw_return:9 market_ew_return:9")


@register("v23_top_k_index", sql("date:d sp500_total_return:9", "y", RET_SQL, BENCH_SQL.replace("pos <= 25", "pos <= 40"),
                                 "y AS (SELECT date, sp AS sp500_total_return FROM topk)"))
def v23(spark, sf):
    return present(top_k_index(returns(spark, sf), 40), "date:d sp500_total_return:9")


YEAR_LAYOUT = "year:i n_alive:i n_delisted:i"


@register("a25_alive_per_year", sql(YEAR_LAYOUT, "y", RET_SQL, """
y AS (SELECT year(date) AS year, count(DISTINCT security_id) AS n_alive, count(*) FILTER (is_delisted_this_month) AS n_delisted
      FROM ret GROUP BY 1)"""))
def a25_years(spark, sf):
    return present(P.alive_per_year(returns(spark, sf)), YEAR_LAYOUT)


@register("a25_deaths_by_kind", sql("year:i kind n:i", "y", RET_SQL, """
y AS (SELECT year(date) AS year, CASE WHEN total_return < -0.5 THEN 'loss' ELSE 'merger' END AS kind, count(*) AS n
      FROM ret WHERE is_delisted_this_month GROUP BY ALL)"""))
def a25_deaths(spark, sf):
    r = returns(spark, sf)
    kinds = (r.where("is_delisted_this_month")
             .select("security_id", F.when(F.col("total_return") < -0.5, "loss").otherwise("merger").alias("kind")))
    return present(P.deaths_by_year(r, kinds), "year:i kind n:i")


LAG_LAYOUT = "rows n_rows:i lag_min:i lag_max:i lag_std:6 lag_mean:6 lag_p5:6 lag_p50:6 lag_p95:6"


@register("a25_publication_lags", sql(LAG_LAYOUT, "y", FUND_SQL, """
lags AS (SELECT 'all' AS rows, available_date - fiscal_period_end AS lag FROM fund
         UNION ALL SELECT 'first', min(available_date) - fiscal_period_end FROM fund GROUP BY security_id, fiscal_period_end),
y AS (SELECT rows, count(*) AS n_rows, min(lag) AS lag_min, max(lag) AS lag_max, avg(lag) AS lag_mean, stddev_samp(lag) AS lag_std,
             quantile_cont(lag, 0.05) AS lag_p5, quantile_cont(lag, 0.5) AS lag_p50, quantile_cont(lag, 0.95) AS lag_p95
      FROM lags GROUP BY rows)""").replace("AS rows", 'AS "rows"').replace("SELECT rows", 'SELECT "rows"').replace("BY rows", 'BY "rows"'))
def a25_lags(spark, sf):
    return present(P.publication_lags(fundamentals(spark, sf)), LAG_LAYOUT)


FP_LAYOUT = "n_rows:i missing_quarter_rate:8 restatement_rate:8 negative_ebit_rate:8 negative_equity_rate:8"


@register("a25_fundamentals_profile", sql(FP_LAYOUT, "y", FUND_SQL, """
fp AS (SELECT security_id, fiscal_period_end FROM fund GROUP BY ALL),
ex AS (SELECT count(*) AS have, round((max(fiscal_period_end) - min(fiscal_period_end)) / 91.3::DOUBLE) + 1 AS expected FROM fp GROUP BY security_id),
y AS (SELECT (SELECT count(*) FROM fund) AS n_rows, 1 - (SELECT sum(have) / sum(expected) FROM ex) AS missing_quarter_rate,
             1 - (SELECT count(*) FROM fp)::DOUBLE / count(*) AS restatement_rate, avg((ebit_ttm < 0)::INT) AS negative_ebit_rate,
             avg((book_equity < 0)::INT) AS negative_equity_rate FROM fund)"""))
def a25_fund(spark, sf):
    return present(P.fundamentals_profile(fundamentals(spark, sf)), FP_LAYOUT)


RP_LAYOUT = ("n_rows:i n_securities:i n_delistings:i delisting_mean:8 delisting_std:8 delisting_min:8 delisting_p25:8 delisting_p50:8 delisting_p75:8 delisting_max:8 price_below_1_rate:8")


@register("a25_returns_profile", sql(RP_LAYOUT, "y", RET_SQL, """
y AS (SELECT count(*) AS n_rows, count(DISTINCT security_id) AS n_securities, count(*) FILTER (is_delisted_this_month) AS n_delistings,
             avg(total_return) FILTER (is_delisted_this_month) AS delisting_mean, stddev_samp(total_return) FILTER (is_delisted_this_month) AS delisting_std,
             min(total_return) FILTER (is_delisted_this_month) AS delisting_min, max(total_return) FILTER (is_delisted_this_month) AS delisting_max,
             quantile_cont(total_return, 0.25) FILTER (is_delisted_this_month) AS delisting_p25, quantile_cont(total_return, 0.5) FILTER (is_delisted_this_month) AS delisting_p50,
             quantile_cont(total_return, 0.75) FILTER (is_delisted_this_month) AS delisting_p75,
             avg((price < 1)::INT) AS price_below_1_rate FROM ret)"""))
def a25_ret(spark, sf):
    return present(P.returns_profile(returns(spark, sf)), RP_LAYOUT)


CAPS = (1, 10, 50, 90, 99, 100)


@register("a25_cap_percentiles", sql(" ".join(f"cap_p{p}:0" for p in CAPS), "y", RET_SQL, "y AS (SELECT " + ", ".join(
    f"quantile_cont(market_cap, {p / 100}) AS cap_p{p}" for p in CAPS) + " FROM ret)"))
def a25_caps(spark, sf):
    return present(P.cap_percentiles(materialize(returns(spark, sf))), " ".join(f"cap_p{p}:0" for p in CAPS))


@register("a25_exchange_shares", sql("exchange n:i share:8", "y", RET_SQL, """
y AS (SELECT exchange, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share
      FROM (SELECT security_id, arg_min(exchange, date) AS exchange FROM ret GROUP BY 1) GROUP BY exchange)"""))
def a25_exchange(spark, sf):
    return present(P.exchange_shares(returns(spark, sf)), "exchange n:i share:8")


@register("a25_sector_shares", sql("sector n:i share:8", "y", RET_SQL, """
y AS (SELECT CASE WHEN c BETWEEN 100 AND 999 THEN 'agriculture' WHEN c BETWEEN 1000 AND 1499 THEN 'mining' WHEN c BETWEEN 1500 AND 1799 THEN 'construction'
                  WHEN c BETWEEN 2000 AND 3999 THEN 'manufacturing' WHEN c BETWEEN 4000 AND 4999 THEN 'transport_utilities' WHEN c BETWEEN 5000 AND 5199 THEN 'wholesale'
                  WHEN c BETWEEN 5200 AND 5999 THEN 'retail' WHEN c BETWEEN 6000 AND 6799 THEN 'finance' WHEN c BETWEEN 7000 AND 8999 THEN 'services'
                  WHEN c BETWEEN 9100 AND 9729 THEN 'public' ELSE 'other' END AS sector, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share
      FROM (SELECT security_id, arg_min(sic_code, date) AS c FROM ret GROUP BY 1) GROUP BY 1)"""))
def a25_sectors(spark, sf):
    return present(P.sector_shares(returns(spark, sf)), "sector n:i share:8")
