"""Scans, point-in-time lookup, snapshot, universe, factors and ranking."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitrank.functions.lineage import materialize
from pitrank.operators.factors import compute_factors, factor_coverage, list_factors
from pitrank.operators.pit import asof_fundamentals
from pitrank.operators.ranking import RankingSpec, rank_stocks, with_average_ranks
from pitrank.operators.schedule import rebalance_dates
from pitrank.operators.snapshot import build_snapshot
from pitrank.operators.trailing import with_trailing
from pitrank.operators.universe import UniverseRule, select_universe
from pitrank.plans.backtest import score
from pitrank.plans.spec import BacktestSpec
from pitrank.sources.canonical import (benchmarks_between, fundamentals_between, month_ends, prepare_panel,
                                       returns_between)

from .common import present, register, sql
from .panel import FUND_SQL, PANEL_SQL, RET_SQL, fundamentals, panel, returns

START, END = "1996-06-30", "2001-06-30"
BUILTIN = list_factors()
SPEC = BacktestSpec(name="quarterly value and quality", start=START, end=END, frequency="quarterly", anchor_month=12,
                    top_n=10, split_date="1999-03-31")
SMALL = BacktestSpec(name="smoke", start=START, end=END, frequency="annual", anchor_month=12, top_n=3,
                     universe=UniverseRule(exchanges=("NYSE", "AMEX", "NASDAQ", "OTC"), exclude_sic_ranges=()))

# ---------------------------------------------------------------- SQL building blocks
WINDOW_SQL = f"""
pret AS (SELECT * FROM ret WHERE date BETWEEN DATE '{START}' - INTERVAL 13 MONTH AND DATE '{END}'),
pfund AS (SELECT * FROM fund WHERE available_date BETWEEN DATE '{START}' - INTERVAL 31 MONTH AND DATE '{END}'),
pbench AS (SELECT * FROM bench WHERE date BETWEEN DATE '{START}' AND DATE '{END}')"""


def form_sql(step: int, sleeves: int = 1, name: str = "form") -> str:
    return f"""
{name} AS (SELECT s.sleeve, d.date AS formation_date
         FROM (SELECT DISTINCT date FROM pret WHERE date >= DATE '{START}') d, range({sleeves}) s(sleeve)
         WHERE d.date < (SELECT max(date) FROM pret) AND (month(d.date) - 12 - s.sleeve + 24) % {step} = 0)"""


def asof_sql(name: str, src: str = "pfund", form: str = "form", back: int = 0, col: str = "available_date",
             stale: int = 548) -> str:
    at = f"CAST(f.formation_date - INTERVAL {back} MONTH AS DATE)"
    return f"""
{name} AS (SELECT * EXCLUDE (rn) FROM (
    SELECT f.formation_date, x.*, row_number() OVER (PARTITION BY f.formation_date, x.security_id
                                                     ORDER BY x.fiscal_period_end DESC, x.available_date DESC) AS rn
    FROM (SELECT DISTINCT formation_date FROM {form}) f
    JOIN {src} x ON x.{col} <= {at} AND x.fiscal_period_end >= {at} - {stale}) WHERE rn = 1)"""


TRAIL_SQL = """
trail AS (SELECT a.security_id, a.date,
     CASE WHEN count(b.total_return) FILTER (b.date <= last_day(a.date - INTERVAL 1 MONTH)) >= 9
          THEN exp(sum(ln(1 + greatest(b.total_return, -0.999::DOUBLE)))
                   FILTER (b.date <= last_day(a.date - INTERVAL 1 MONTH))) - 1 END AS mom_12_1,
     CASE WHEN count(b.total_return) >= 9 THEN stddev_samp(b.total_return) * sqrt(12) END AS vol_12m
  FROM pret a JOIN pret b ON a.security_id = b.security_id AND b.date > last_day(a.date - INTERVAL 12 MONTH)
                         AND b.date <= a.date
  GROUP BY a.security_id, a.date)"""

SNAP_SQL = ",".join([asof_sql("now_"), asof_sql("before_", back=12), TRAIL_SQL, """
snap AS (SELECT f.sleeve, f.formation_date, c.*, n.* EXCLUDE (formation_date, security_id, available_date),
                b.total_assets AS total_assets_prior, b.shares_diluted AS shares_diluted_prior, t.mom_12_1, t.vol_12m,
                f.formation_date - n.fiscal_period_end AS fundamentals_age_days
         FROM form f JOIN pret c ON c.date = f.formation_date
         LEFT JOIN now_ n ON n.formation_date = c.date AND n.security_id = c.security_id
         LEFT JOIN before_ b ON b.formation_date = c.date AND b.security_id = c.security_id
         LEFT JOIN trail t ON t.date = c.date AND t.security_id = c.security_id)"""])


def universe_sql(max_names: int = 5000, where: str = "exchange IN ('NYSE','AMEX','NASDAQ') AND NOT (sic_code BETWEEN "
                 "6000 AND 6999) AND NOT (sic_code BETWEEN 4900 AND 4999)", src: str = "snap", name: str = "uni") -> str:
    return f"""
{name} AS (SELECT * FROM {src} WHERE NOT is_delisted_this_month AND market_cap >= 50e6 AND price >= 1 AND {where}
        QUALIFY row_number() OVER (PARTITION BY formation_date ORDER BY market_cap DESC, security_id) <= {max_names})"""


FACTOR_SQL = {
    "return_on_capital": ("ebit_ttm", "CASE WHEN current_assets - cash - (current_liabilities - short_term_debt) < 0 THEN 0 "
                          "ELSE current_assets - cash - (current_liabilities - short_term_debt) END + net_ppe"),
    "earnings_yield": ("ebit_ttm", "market_cap + long_term_debt + short_term_debt + preferred_stock + minority_interest - cash"),
    "book_to_market": ("CASE WHEN book_equity > 0 THEN book_equity END", "market_cap"),
    "earnings_to_price": ("net_income_ttm", "market_cap"),
    "sales_to_price": ("revenue_ttm", "market_cap"),
    "fcf_yield": ("(operating_cash_flow_ttm - capex_ttm)", "market_cap"),
    "shareholder_yield": ("(dividends_ttm + (shares_diluted_prior - shares_diluted) * price)", "market_cap"),
    "gross_profitability": ("gross_profit_ttm", "total_assets"),
    "roe": ("net_income_ttm", "book_equity"),
    "accruals": ("(net_income_ttm - operating_cash_flow_ttm)", "total_assets"),
    "asset_growth": ("total_assets", "total_assets_prior"),
}


# written out for the SQL side, apart from the library's own definitions
LOW_IS_GOOD = ("accruals", "asset_growth", "volatility_12m")


def factor_sql(f: str) -> str:
    if f == "momentum_12_1":
        return "mom_12_1"
    if f == "volatility_12m":
        return "vol_12m"
    num, den = FACTOR_SQL[f]
    x = f"CASE WHEN ({den}) > 0 THEN {num} / ({den}) END"
    return f"({x}) - 1" if f == "asset_growth" else x


def values_sql(names, src: str = "uni", name: str = "vals") -> str:
    return f"\n{name} AS (SELECT *, {', '.join(f'{factor_sql(f)} AS {f}' for f in names)} FROM {src})"


def avg_rank_sql(x: str, desc: bool, part: str = "formation_date") -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} {'DESC' if desc else 'ASC'} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE END")


def rank_sum_sql(weights: dict, src: str = "vals", name: str = "ranked", policy: str = "drop", part: str = "formation_date") -> str:
    tot = sum(weights.values())
    ranks, score_, raw = [], [], []
    for f, w in weights.items():
        r = avg_rank_sql(f, f not in LOW_IS_GOOD, part)
        if policy == "median":
            r = f"coalesce({r}, (count({f}) OVER (PARTITION BY {part}) + 1) / 2.0::DOUBLE)"
        ranks.append(f"{r} AS {f}_rank")
        score_.append(f"{w / tot}::DOUBLE * {f}_rank")
        raw.append(f"{w / tot * len(weights)}::DOUBLE * {f}_rank")
    return f"""
{name}_0 AS (SELECT *, {', '.join(ranks)} FROM {src}),
{name}_1 AS (SELECT *, {' + '.join(score_)} AS score, {' + '.join(raw)} AS score_raw FROM {name}_0
             WHERE {' AND '.join(f'{f}_rank IS NOT NULL' for f in weights)}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score, security_id) AS rank FROM {name}_1)"""


MAGIC = {"return_on_capital": 0.5, "earnings_yield": 0.5}
BASE = [PANEL_SQL, WINDOW_SQL]
RANKED = [*BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(MAGIC), rank_sum_sql(MAGIC)]

# ---------------------------------------------------------------- scans
RET_LAYOUT = ("security_id date:d total_return:9 price:6 shares_outstanding:2 market_cap:0 exchange sic_code:i "
              "is_delisted_this_month")


@register("s01_returns_bounds", sql(RET_LAYOUT, "x", RET_SQL, f"x AS (SELECT * FROM ret WHERE date BETWEEN DATE '{START}' AND DATE '{END}')"))
def s01(spark: SparkSession, sf: str) -> DataFrame:
    return present(returns_between(returns(spark, sf), START, END), RET_LAYOUT)


FUND_LAYOUT = ("security_id fiscal_period_end:d available_date:d ebit_ttm:2 revenue_ttm:2 gross_profit_ttm:2 "
               "net_income_ttm:2 capex_ttm:2 total_assets:2 book_equity:2 shares_diluted:2")


@register("s02_fundamentals_bounds", sql(FUND_LAYOUT, "x", FUND_SQL, f"""x AS (SELECT * FROM fund
          WHERE available_date >= DATE '{START}' - INTERVAL 18 MONTH AND available_date <= DATE '{END}')"""))
def s02(spark, sf):
    return present(fundamentals_between(fundamentals(spark, sf), START, END), FUND_LAYOUT)


BENCH_LAYOUT = "date:d sp500_total_return:9 market_vw_return:9 market_ew_return:9 risk_free_rate:9"


@register("s03_benchmarks_bounds", sql(BENCH_LAYOUT, "pbench", *BASE))
def s03(spark, sf):
    return present(benchmarks_between(panel(spark, sf, filings=False).benchmarks, START, END), BENCH_LAYOUT)


@register("s04_prepared_months", sql("date:d n:i", "x", RET_SQL, f"""x AS (SELECT date, count(*) AS n FROM ret
          WHERE date BETWEEN DATE '{START}' - INTERVAL 13 MONTH AND DATE '{END}' GROUP BY date)"""))
def s04(spark, sf):
    cut = prepare_panel(panel(spark, sf, filings=False), START, END)
    return present(cut.returns.groupBy("date").agg(F.count(F.lit(1)).alias("n")), "date:d n:i")


# ---------------------------------------------------------------- calendars
for _freq, _step, _k in (("annual", 12, 12), ("quarterly", 3, 3), ("monthly", 1, 1)):
    def _dates(spark, sf, freq=_freq, k=_k):
        cut = prepare_panel(panel(spark, sf, filings=False), START, END)
        return present(rebalance_dates(month_ends(cut.returns, START), freq, 12, k), "sleeve:i formation_date:d")
    register(f"p01_rebalance_{_freq}", sql("sleeve:i formation_date:d", "form", *BASE, form_sql(_step, _k)))(_dates)


# ---------------------------------------------------------------- point in time
def _formations(spark, sf, freq="monthly", filings=False):
    """The cut panel and its formation dates, written once. ``filings``: the accounting table is read several times."""
    whole = prepare_panel(panel(spark, sf, filings), START, END)
    return whole, materialize(rebalance_dates(month_ends(whole.returns, START), freq, 12))


ASOF_LAYOUT = "formation_date:d security_id fiscal_period_end:d available_date:d ebit_ttm:2 total_assets:2"


@register("j01_asof_fundamentals", sql(ASOF_LAYOUT, "x", *BASE, form_sql(1), asof_sql("x")))
def j01(spark, sf):
    cut, dates = _formations(spark, sf)
    return present(asof_fundamentals(cut.fundamentals, dates), ASOF_LAYOUT)


# some first filings are not known to be public yet (a far date), some restatements have a date that can't be right
ODD_DATES = """
odd AS (SELECT * REPLACE (CASE WHEN month(fiscal_period_end) = 6 AND available_date - fiscal_period_end < 90 THEN DATE '9999-12-31'
                               WHEN month(fiscal_period_end) = 12 AND available_date - fiscal_period_end >= 90 THEN DATE '0300-01-01'
                               ELSE available_date END AS available_date) FROM pfund)"""


@register("j01_asof_odd_dates", sql(ASOF_LAYOUT, "x", *BASE, form_sql(1), ODD_DATES,
                                    asof_sql("x", src="odd", col="fiscal_period_end")))
def j01_odd(spark, sf):
    cut, dates = _formations(spark, sf)
    lag = F.datediff("available_date", "fiscal_period_end")
    odd = cut.fundamentals.withColumn(
        "available_date", F.when((F.month("fiscal_period_end") == 6) & (lag < 90), F.lit("9999-12-31").cast("date"))
        .when((F.month("fiscal_period_end") == 12) & (lag >= 90), F.lit("0300-01-01").cast("date"))
        .otherwise(F.col("available_date")))
    return present(asof_fundamentals(odd, dates, asof_col="fiscal_period_end"), ASOF_LAYOUT)


@register("j01_asof_no_staleness_limit", sql(ASOF_LAYOUT, "x", *BASE, form_sql(3), asof_sql("x", stale=100000)))
def j01_unlimited(spark, sf):
    cut, dates = _formations(spark, sf, "quarterly")
    return present(asof_fundamentals(cut.fundamentals, dates, max_staleness_days=None, horizon=END), ASOF_LAYOUT)


PRIOR_LAYOUT = "formation_date:d security_id total_assets_prior:2 shares_diluted_prior:2"


@register("j02_prior_year_asof", sql(PRIOR_LAYOUT, "y", *BASE, form_sql(1), asof_sql("x", back=12), """
          y AS (SELECT formation_date, security_id, total_assets AS total_assets_prior, shares_diluted AS shares_diluted_prior FROM x)"""))
def j02(spark, sf):
    cut, dates = _formations(spark, sf)
    x = asof_fundamentals(cut.fundamentals, dates, shift_months=12, values=["total_assets", "shares_diluted"])
    return present(x.withColumnsRenamed({"total_assets": "total_assets_prior", "shares_diluted": "shares_diluted_prior"}),
                   PRIOR_LAYOUT)


SNAP_LAYOUT = ("formation_date:d security_id price:6 market_cap:0 exchange sic_code:i is_delisted_this_month "
               "fiscal_period_end:d ebit_ttm:2 revenue_ttm:2 net_ppe:2 book_equity:2 total_assets_prior:2 "
               "shares_diluted_prior:2 mom_12_1:9 vol_12m:9 fundamentals_age_days:9")


@register("j03_snapshot", sql(SNAP_LAYOUT, "snap", *BASE, form_sql(3), SNAP_SQL))
def j03(spark, sf):
    cut, dates = _formations(spark, sf, "quarterly", filings=True)
    return present(build_snapshot(cut.returns, cut.fundamentals, dates), SNAP_LAYOUT)


# ---------------------------------------------------------------- trailing windows
@register("w01_w02_momentum_volatility", sql("security_id date:d mom_12_1:9 vol_12m:9", "trail", RET_SQL,
                                             "pret AS (SELECT * FROM ret)", TRAIL_SQL))
def w01(spark, sf):
    return present(with_trailing(returns(spark, sf)), "security_id date:d mom_12_1:9 vol_12m:9")


@register("w03_momentum_6_0", sql("security_id date:d mom_6_0:9", "x", RET_SQL, """
x AS (SELECT a.security_id, a.date, CASE WHEN count(*) >= 6 THEN exp(sum(ln(1 + greatest(b.total_return, -0.999::DOUBLE)))) - 1 END AS mom_6_0
      FROM ret a JOIN ret b ON a.security_id = b.security_id AND b.date > last_day(a.date - INTERVAL 6 MONTH) AND b.date <= a.date
      GROUP BY a.security_id, a.date)"""))
def w03(spark, sf):
    return present(with_trailing(returns(spark, sf), 6, 0, momentum="mom_6_0", volatility=None), "security_id date:d mom_6_0:9")


# ---------------------------------------------------------------- universe and factors
@register("f01_universe", sql("formation_date:d security_id market_cap:0", "uni", *BASE, form_sql(1),
                              "sec AS (SELECT f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date)",
                              universe_sql(src="sec")))
def f01(spark, sf):
    cut, dates = _formations(spark, sf)
    sec = cut.returns.join(dates, F.col("date") == F.col("formation_date"))
    return present(select_universe(sec), "formation_date:d security_id market_cap:0")


@register("f01_universe_with_nan", sql("formation_date:d security_id market_cap:0", "uni", *BASE, form_sql(1), """
          sec AS (SELECT f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date
                  WHERE right(r.security_id, 1) NOT IN ('3', '8'))""", universe_sql(40, src="sec")))
def f01_nan(spark, sf):
    """One security in ten has no usable capitalisation, another one no usable price."""
    cut, dates = _formations(spark, sf)
    nan, last = F.lit(float("nan")), F.substring("security_id", -1, 1)
    sec = (cut.returns.join(dates, F.col("date") == F.col("formation_date"))
           .withColumn("market_cap", F.when(last == "3", nan).otherwise(F.col("market_cap")))
           .withColumn("price", F.when(last == "8", nan).otherwise(F.col("price"))))
    return present(select_universe(sec, UniverseRule(max_names=40)), "formation_date:d security_id market_cap:0")


@register("f02_largest_names", sql("formation_date:d security_id market_cap:0", "uni", *BASE, form_sql(1),
                                   "sec AS (SELECT f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date)",
                                   universe_sql(20, "exchange IN ('NYSE', 'OTC') AND NOT (sic_code BETWEEN 3000 AND 3999)", src="sec")))
def f02(spark, sf):
    cut, dates = _formations(spark, sf)
    sec = cut.returns.join(dates, F.col("date") == F.col("formation_date"))
    rule = UniverseRule(max_names=20, exchanges=("NYSE", "OTC"), exclude_sic_ranges=((3000, 3999),))
    return present(select_universe(sec, rule), "formation_date:d security_id market_cap:0")


ALL_LAYOUT = "formation_date:d security_id " + " ".join(f"{f}:9" for f in BUILTIN)


def _snapshot_universe(spark, sf, freq="quarterly", rule=UniverseRule(), requires=None):
    cut, dates = _formations(spark, sf, freq, filings=True)
    return build_snapshot(cut.returns, cut.fundamentals, dates, requires=requires,
                          universe=lambda s: select_universe(s, rule))


@register("x01_x13_factors", sql(ALL_LAYOUT, "vals", *BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(BUILTIN)))
def x01(spark, sf):
    return present(compute_factors(_snapshot_universe(spark, sf), BUILTIN), ALL_LAYOUT)


COVER_LAYOUT = "formation_date:d factor n_securities:i n_available:i missing_rate:4 direction"


@register("x16_factor_coverage", sql(COVER_LAYOUT, "x", *BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(BUILTIN),
          "x AS (" + " UNION ALL ".join(
              f"SELECT formation_date, '{f}' AS factor, count(*) AS n_securities, count({f}) AS n_available, "
              f"round(1 - count({f})::DOUBLE / count(*), 4) AS missing_rate, '{"lower" if f in LOW_IS_GOOD else "higher"}' AS direction "
              "FROM vals GROUP BY formation_date" for f in BUILTIN) + ")"))
def x16(spark, sf):
    return present(factor_coverage(_snapshot_universe(spark, sf), BUILTIN, keys=["formation_date"]), COVER_LAYOUT)


# ---------------------------------------------------------------- ranking
def _values(spark, sf, names, rule=UniverseRule()):
    from pitrank.operators.factors import required_columns
    snap = _snapshot_universe(spark, sf, rule=rule, requires=required_columns(names))
    return compute_factors(snap, names).select("formation_date", "security_id", *names)


W04_LAYOUT = "formation_date:d security_id gross_profitability_rank:1 accruals_rank:1 dividend_band_rank:1"
W04_SQL = sql(W04_LAYOUT, "x", *BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(["gross_profitability", "accruals"]), f"""
x AS (SELECT formation_date, security_id, {avg_rank_sql('gross_profitability', True)} AS gross_profitability_rank,
             {avg_rank_sql('accruals', False)} AS accruals_rank, {avg_rank_sql('band', False)} AS dividend_band_rank
      FROM (SELECT *, CASE WHEN dividends_ttm IS NOT NULL THEN CASE WHEN dividends_ttm / revenue_ttm < 0.005 THEN 0 ELSE 1 END END AS band FROM vals))""")


def _w04(spark, sf, bounded):
    names = ["gross_profitability", "accruals"]
    snap = _snapshot_universe(spark, sf, requires={"gross_profit_ttm", "total_assets", "net_income_ttm", "operating_cash_flow_ttm",
                                                   "dividends_ttm", "revenue_ttm"})
    v = compute_factors(snap, names).withColumn(
        "dividend_band", F.when(F.col("dividends_ttm").isNotNull(),
                                F.when(F.col("dividends_ttm") / F.col("revenue_ttm") < 0.005, 0).otherwise(1)))
    v = v.select("formation_date", "security_id", *names, F.col("dividend_band").cast("double"))
    out = with_average_ranks(v if bounded else materialize(v),
                             ["formation_date"], {"gross_profitability": False, "accruals": True, "dividend_band": True}, bounded)
    return present(out, W04_LAYOUT)


@register("w04_avg_rank", W04_SQL)
def w04(spark, sf):
    return _w04(spark, sf, True)


@register("w04_avg_rank_unbounded_group", W04_SQL)
def w04_wide(spark, sf):
    return _w04(spark, sf, False)


RANK_LAYOUT = "formation_date:d security_id return_on_capital_rank:1 earnings_yield_rank:1 score:6 score_raw:6 rank:i"


@register("a01_rank_sum", sql(RANK_LAYOUT, "ranked", *RANKED))
def a01(spark, sf):
    return present(rank_stocks(_values(spark, sf, list(MAGIC)), RankingSpec(MAGIC)), RANK_LAYOUT)


FIVE = {"earnings_yield": 2.0, "gross_profitability": 1.0, "accruals": 1.0, "asset_growth": 0.5, "momentum_12_1": 1.5}
MEDIAN_LAYOUT = "formation_date:d security_id " + " ".join(f"{f}_rank:1" for f in FIVE) + " score:6 score_raw:6 rank:i"


@register("a03_median_policy", sql(MEDIAN_LAYOUT, "ranked", *BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(FIVE),
                                   rank_sum_sql(FIVE, policy="median")))
def a03(spark, sf):
    return present(rank_stocks(_values(spark, sf, list(FIVE)), RankingSpec(FIVE, missing_policy="median")), MEDIAN_LAYOUT)


def zscore_sql(weights: dict, policy: str, src: str = "vals", name: str = "ranked") -> str:
    tot = sum(weights.values())
    q = ", ".join(f"quantile_cont({f}, 0.01) AS {f}_lo, quantile_cont({f}, 0.99) AS {f}_hi" for f in weights)
    clip = ", ".join(f"CASE WHEN {f} < {f}_lo THEN {f}_lo WHEN {f} > {f}_hi THEN {f}_hi ELSE {f} END AS {f}_w" for f in weights)
    mom = ", ".join(f"avg({f}_w) AS {f}_mu, stddev_samp({f}_w) AS {f}_sd" for f in weights)
    z = []
    for f in weights:
        e = f"CASE WHEN {f}_sd > 0 THEN ({f}_w - {f}_mu) / {f}_sd ELSE {f}_w * 0 END"
        e = f"-({e})" if f in LOW_IS_GOOD else e
        z.append((f"coalesce({e}, 0)" if policy == "median" else e) + f" AS {f}_z")
    ranks = ", ".join(f"{avg_rank_sql(f + '_z', True)} AS {f}_rank" for f in weights)
    score_ = " + ".join(f"{w / tot}::DOUBLE * {f}_z" for f, w in weights.items())
    return f"""
zq AS (SELECT formation_date, {q} FROM {src} GROUP BY formation_date),
zc AS (SELECT v.formation_date, v.security_id, {clip} FROM {src} v JOIN zq USING (formation_date)),
zm AS (SELECT formation_date, {mom} FROM zc GROUP BY formation_date),
zz AS (SELECT formation_date, security_id, {', '.join(z)} FROM zc JOIN zm USING (formation_date)),
zr AS (SELECT *, {ranks} FROM zz),
zs AS (SELECT *, {score_} AS score FROM zr WHERE {' AND '.join(f'{f}_z IS NOT NULL' for f in weights)}),
{name} AS (SELECT *, score AS score_raw, row_number() OVER (PARTITION BY formation_date ORDER BY round(score, 9) DESC, security_id) AS rank FROM zs)"""


Z_LAYOUT = "formation_date:d security_id " + " ".join(f"{f}_z:7 {f}_rank:1" for f in FIVE) + " score:7 rank:i"
Z_PRE = [*BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(FIVE)]


def _z(spark, sf, policy, bounded=True, ranges=None):
    return present(rank_stocks(_values(spark, sf, list(FIVE)), RankingSpec(FIVE, "zscore", policy), bounded=bounded,
                               ranges=ranges), Z_LAYOUT)


@register("a02_zscore_drop", sql(Z_LAYOUT, "ranked", *Z_PRE, zscore_sql(FIVE, "drop")))
def a02(spark, sf):
    return _z(spark, sf, "drop")


@register("a02_zscore_median", sql(Z_LAYOUT, "ranked", *Z_PRE, zscore_sql(FIVE, "median")))
def a02_median(spark, sf):
    return _z(spark, sf, "median")


@register("a02_zscore_unbounded_group", sql(Z_LAYOUT, "ranked", *Z_PRE, zscore_sql(FIVE, "drop")))
def a02_wide(spark, sf):
    return _z(spark, sf, "drop", False)


FLAG_LAYOUT = "formation_date:d security_id rank:i score_raw:6 market_cap:0"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    s = score(panel(spark, sf), SMALL)
    return present(s.rankings.where(F.col("rank") <= SMALL.top_n), FLAG_LAYOUT)
