"""Portfolio construction and accounting. The SQL side walks month by month with recursion."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitrank.analytics.deciles import decile_assignments, decile_returns, decile_scored, decile_summary, decile_table
from pitrank.analytics.nulls import (null_summary, null_values, oracle_fraction, panel_metrics, placement, shuffled_scores,
                                     multiple_testing_bar)
from pitrank.analytics.profile import size_tilt
from pitrank.functions.lineage import materialize
from pitrank.operators.costs import CostModel
from pitrank.operators.portfolio import target_weights
from pitrank.operators.ranking import select_top
from pitrank.plans.backtest import holdings_at, run_backtest, run_scores, score, top_of_ranking, universe_funnel
from pitrank.sources.canonical import Panel

from .common import present, register, sql
from .core import (BASE, END, MAGIC, RANKED, SNAP_SQL, SPEC, START, form_sql, rank_sum_sql, universe_sql,
                   values_sql)
from .panel import BENCH_SQL, PANEL_SQL, RET_SQL, panel, returns

# Fixed values, written out for the SQL side: (market cap in dollars, one-way cost in basis points).
SIZE_ANCHORS = ((1e7, 150.0), (5e7, 80.0), (2.5e8, 40.0), (1e9, 20.0), (1e10, 8.0), (1e11, 5.0))
COST_CTE = "anchors(x0, y0, x1, y1) AS (VALUES " + ", ".join(
    f"(log10({a}::DOUBLE), {b}::DOUBLE, log10({c}::DOUBLE), {d}::DOUBLE)"
    for (a, b), (c, d) in zip(SIZE_ANCHORS, SIZE_ANCHORS[1:])) + ")"


def cost_sql(cap: str) -> str:
    x = f"log10(greatest(coalesce({cap}, 1e7), 1e5))"
    lo, hi = SIZE_ANCHORS[0], SIZE_ANCHORS[-1]
    return (f"(CASE WHEN {x} <= log10({lo[0]}::DOUBLE) THEN {lo[1]} WHEN {x} > log10({hi[0]}::DOUBLE) THEN {hi[1]} ELSE "
            f"(SELECT y0 + (y1 - y0) * ({x} - x0) / (x1 - x0) FROM anchors WHERE {x} > x0 AND {x} <= x1) END / 1e4)")


def windows_sql(form: str = "form", keys: str = "sleeve", name: str = "wins") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
{name} AS (SELECT *, coalesce(next_formation, (SELECT max(date) FROM pret)) AS next_date
         FROM (SELECT *, lead(formation_date) OVER ({part} ORDER BY formation_date) AS next_formation FROM {form}))"""


def walk_sql(targets: str, keys: str = "sleeve", wins: str = "wins", p: str = "s") -> str:
    """CTEs <p>_walk, <p>_gross, <p>_trades, <p>_month."""
    k = f"{keys}, " if keys else ""
    tk = ", ".join(f"t.{x}" for x in keys.split(", ")) + ", " if keys else ""
    on = " AND ".join(f"a.{x} = b.{x}" for x in (keys.split(", ") if keys else []) + ["formation_date"])
    return f"""
{p}_walk AS (
    SELECT {tk} t.formation_date, w.next_date, w.next_formation, t.security_id, t.formation_date AS date,
           t.weight AS w, NULL::DOUBLE AS w0, NULL::DOUBLE AS r, NULL::DOUBLE AS cap
    FROM {targets} t JOIN {wins} w USING ({k} formation_date)
    UNION ALL
    SELECT {k} formation_date, next_date, next_formation, security_id, date,
           CASE WHEN sum(w0 * (1 + r)) OVER g > 0 THEN w0 * (1 + r) / sum(w0 * (1 + r)) OVER g ELSE 0 END AS w, w0, r, cap
    FROM (SELECT {k} x.formation_date, x.next_date, x.next_formation, x.security_id, y.date,
                 CASE WHEN sum(x.w) OVER h > 0 THEN x.w / sum(x.w) OVER h ELSE 0 END AS w0,
                 y.total_return AS r, y.market_cap AS cap
          FROM {p}_walk x JOIN pret y ON y.security_id = x.security_id AND y.date = last_day(CAST(x.date + INTERVAL 1 DAY AS DATE))
          WHERE y.date <= x.next_date WINDOW h AS (PARTITION BY {k} x.formation_date))
    WINDOW g AS (PARTITION BY {k} formation_date)),
{p}_gross AS (SELECT {k} formation_date, date, sum(w0 * r) AS g, count(*) FILTER (w0 > 0) AS n
              FROM {p}_walk WHERE date > formation_date GROUP BY ALL),
{p}_trades AS (SELECT {k} formation_date, sum(abs(coalesce(a.weight, 0) - coalesce(b.w, 0))) / 2 AS turnover,
                      sum(abs(coalesce(a.weight, 0) - coalesce(b.w, 0)) * {cost_sql('coalesce(a.market_cap, b.cap)')}) AS cost
               FROM {targets} a FULL JOIN (SELECT * REPLACE (next_formation AS formation_date) FROM {p}_walk WHERE date = next_formation) b
                    USING ({k} formation_date, security_id)
               GROUP BY ALL),
{p}_grid AS (SELECT {k} formation_date, c.date, row_number() OVER (PARTITION BY {k} formation_date ORDER BY c.date) AS pos
             FROM {wins} w JOIN (SELECT DISTINCT date FROM pret) c ON c.date > w.formation_date AND c.date <= w.next_date),
{p}_month AS (SELECT {k} formation_date, q.date, coalesce(g, 0) AS gross, coalesce(n, 0) AS n_holdings,
                     CASE WHEN pos = 1 THEN coalesce(t.turnover, 0) END AS turnover,
                     CASE WHEN pos = 1 THEN coalesce(t.cost, 0) ELSE 0 END AS cost,
                     coalesce(g, 0) - CASE WHEN pos = 1 THEN coalesce(t.cost, 0) ELSE 0 END AS net
              FROM {p}_grid q LEFT JOIN {p}_gross USING ({k} formation_date, date) LEFT JOIN {p}_trades t USING ({k} formation_date))"""


def targets_sql(n: int, name: str = "targets", weighting: str = "equal", src: str = "ranked", part: str = "sleeve, formation_date") -> str:
    w = "1.0::DOUBLE / count(*) OVER g" if weighting == "equal" else "market_cap / sum(market_cap) OVER g"
    return (f"\n{name} AS (SELECT *, {w} AS weight FROM {src} WHERE rank <= {n} "
            f"WINDOW g AS (PARTITION BY {part}))")


UNI_TARGETS = ("\nutargets AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY sleeve, formation_date) AS weight FROM uni)")
BOOKS = [windows_sql(), COST_CTE, targets_sql(SPEC.top_n), walk_sql("targets"), UNI_TARGETS, walk_sql("utargets", p="u")]
MONTHLY_CTE = """
monthly AS (SELECT s.date, s.gross, s.net, s.turnover, s.cost, s.n_holdings, u.gross AS universe_ew,
                   b.sp500_total_return, b.market_vw_return, b.market_ew_return, b.risk_free_rate
            FROM s_month s LEFT JOIN u_month u USING (sleeve, date) LEFT JOIN pbench b USING (date))"""
RUN = [*RANKED, *BOOKS, MONTHLY_CTE]
MONTHLY_LAYOUT = ("date:d gross:9 net:9 turnover:9 cost:9 n_holdings:i universe_ew:9 sp500_total_return:9 market_vw_return:9 "
                  "market_ew_return:9 risk_free_rate:9")


# ---------------------------------------------------------------- costs and weights
@register("p03_cost_curve", sql("security_id date:d one_way:9 stressed:9 flat:9", "x", COST_CTE, PANEL_SQL, f"""
x AS (SELECT security_id, date, {cost_sql('cap')} AS one_way, {cost_sql('cap')} * 2.5 AS stressed, 0.002::DOUBLE AS flat
      FROM (SELECT *, CASE WHEN sic_code % 5 = 0 THEN NULL ELSE market_cap / power(10, sic_code % 6) END AS cap FROM ret))"""))
def p03(spark, sf):
    cap = F.when(F.pmod("sic_code", F.lit(5)) != 0,
                 F.col("market_cap") / F.pow(F.lit(10.0), F.pmod("sic_code", F.lit(6)).cast("double")))
    df = returns(spark, sf).withColumn("cap", cap)
    return present(df.select("security_id", "date", CostModel().one_way("cap").alias("one_way"),
                             CostModel(multiplier=2.5).one_way("cap").alias("stressed"),
                             CostModel("flat").one_way("cap").alias("flat")),
                   "security_id date:d one_way:9 stressed:9 flat:9")


W_LAYOUT = "formation_date:d security_id rank:i weight:9"


@register("p04_cap_weights", sql(W_LAYOUT, "targets", *RANKED, targets_sql(SPEC.top_n, weighting="cap")))
def p04(spark, sf):
    s = score(panel(spark, sf), SPEC)
    return present(target_weights(select_top(s.rankings, SPEC.top_n), ["sleeve", "formation_date"], "cap"), W_LAYOUT)


# ---------------------------------------------------------------- one backtest
@register("p12_backtest_monthly", sql(MONTHLY_LAYOUT, "monthly", *RUN))
def p12(spark, sf):
    return present(run_backtest(panel(spark, sf), SPEC).monthly, MONTHLY_LAYOUT)


CAP_MONTHLY = replace(SPEC, weighting="cap", frequency="monthly", top_n=5,
                      factors={"momentum_12_1": 1.0, "book_to_market": 2.0}, costs=CostModel(multiplier=2.0))


@register("p05_p07_monthly_cap_weighted", sql(
    "date:d gross:9 net:9 turnover:9 cost:9 n_holdings:i", "y", *BASE, form_sql(1), SNAP_SQL, universe_sql(),
    values_sql(CAP_MONTHLY.factors), rank_sum_sql(CAP_MONTHLY.factors), windows_sql(), COST_CTE,
    targets_sql(5, weighting="cap"), walk_sql("targets"),
    "y AS (SELECT * REPLACE (2 * cost AS cost, gross - 2 * cost AS net) FROM s_month)"))
def p05(spark, sf):
    return present(run_backtest(panel(spark, sf), CAP_MONTHLY).monthly, "date:d gross:9 net:9 turnover:9 cost:9 n_holdings:i")


SLEEVED = replace(SPEC, frequency="annual", sleeves=True)
SLEEVE_LAYOUT = "date:d gross:9 net:9 turnover:9 cost:9 n_holdings:i universe_ew:9"


@register("p08_sleeves", sql(SLEEVE_LAYOUT, "y", *BASE, form_sql(12, 12), SNAP_SQL, universe_sql(), values_sql(MAGIC),
                             rank_sum_sql(MAGIC), *BOOKS, """
y AS (SELECT s.date, avg(s.gross) AS gross, avg(s.net) AS net, sum(s.turnover) / 12 AS turnover, avg(s.cost) AS cost,
             sum(s.n_holdings) AS n_holdings, avg(u.gross) AS universe_ew
      FROM s_month s LEFT JOIN u_month u USING (sleeve, date) GROUP BY s.date)"""))
def p08(spark, sf):
    return present(run_backtest(panel(spark, sf), SLEEVED).monthly, SLEEVE_LAYOUT)


HOLD_LAYOUT = "formation_date:d sleeve:i security_id rank:i score_raw:6 weight:9 holding_return:9 market_cap:0"
HOLD_CTE = """
hold AS (SELECT t.sleeve, t.formation_date, t.security_id, t.rank, t.score_raw, t.weight, t.market_cap,
                exp(sum(ln(1 + greatest(r.total_return, -0.999::DOUBLE)))) - 1 AS holding_return
         FROM targets t JOIN wins w USING (sleeve, formation_date)
         LEFT JOIN pret r ON r.security_id = t.security_id AND r.date > t.formation_date AND r.date <= w.next_date
         GROUP BY ALL)"""


@register("p10_p11_holdings", sql(HOLD_LAYOUT, "hold", *RANKED, windows_sql(), targets_sql(SPEC.top_n), HOLD_CTE))
def p10(spark, sf):
    return present(run_backtest(panel(spark, sf), SPEC).holdings, HOLD_LAYOUT)


T_DATE = "1999-06-30"


@register("f08_holdings_at", sql(HOLD_LAYOUT, "y", *RANKED, windows_sql(), targets_sql(SPEC.top_n), HOLD_CTE,
                                 f"y AS (SELECT * FROM hold WHERE formation_date = DATE '{T_DATE}' AND sleeve = 0)"))
def f08(spark, sf):
    return present(holdings_at(run_backtest(panel(spark, sf), SPEC), T_DATE), HOLD_LAYOUT)


TOP_LAYOUT = "formation_date:d security_id rank:i score_raw:6 weight:9"


@register("t04_top_of_ranking", sql(TOP_LAYOUT, "y", *RANKED, targets_sql(SPEC.top_n), f"""
y AS (SELECT r.*, t.weight FROM ranked r LEFT JOIN targets t USING (formation_date, security_id)
      WHERE formation_date = DATE '{T_DATE}' ORDER BY r.rank LIMIT 300)""").replace("rank AS", "rank AS"))
def t04(spark, sf):
    return present(top_of_ranking(run_backtest(panel(spark, sf), SPEC), T_DATE), TOP_LAYOUT)


FUNNEL_LAYOUT = "formation_date:d sleeve:i n_alive:i n_universe:i n_ranked:i n_dropped_missing:i"


@register("a04_universe_funnel", sql(FUNNEL_LAYOUT, "y", *RANKED, """
y AS (SELECT f.formation_date, f.sleeve, (SELECT count(*) FROM pret WHERE date = f.formation_date) AS n_alive,
             (SELECT count(*) FROM uni WHERE formation_date = f.formation_date) AS n_universe,
             (SELECT count(*) FROM ranked WHERE formation_date = f.formation_date) AS n_ranked,
             (SELECT count(*) FROM uni WHERE formation_date = f.formation_date)
             - (SELECT count(*) FROM ranked WHERE formation_date = f.formation_date) AS n_dropped_missing FROM form f)"""))
def a04(spark, sf):
    return present(universe_funnel(score(panel(spark, sf), SPEC)), FUNNEL_LAYOUT)


TILT_LAYOUT = "formation_date:d median_universe:0 median_held:0 share_small:6 n_held:i"


@register("a26_size_tilt", sql(TILT_LAYOUT, "y", *RANKED, """
q AS (SELECT formation_date, median(market_cap) AS median_universe, quantile_cont(market_cap, 0.25) AS q1 FROM ranked GROUP BY 1),
y AS (SELECT formation_date, median_universe, median(market_cap) AS median_held,
             avg((market_cap < q1)::INT) AS share_small, count(*) AS n_held
      FROM ranked JOIN q USING (formation_date) WHERE rank <= 10 GROUP BY formation_date, median_universe)"""))
def a26(spark, sf):
    return present(size_tilt(run_backtest(panel(spark, sf), SPEC).rankings), TILT_LAYOUT)


SHIFTED = replace(SPEC, date_shift_months=-1)


@register("p13_q14_shifted_portfolio", sql("date:d gross:9 universe_ew:9 turnover:9", "y", *RANKED, COST_CTE, targets_sql(10), UNI_TARGETS, """
sform AS (SELECT sleeve, last_day(CAST(formation_date - INTERVAL 1 MONTH AS DATE)) AS formation_date FROM form)""",
    windows_sql("sform"), """
st AS (SELECT * REPLACE (last_day(CAST(formation_date - INTERVAL 1 MONTH AS DATE)) AS formation_date) FROM targets),
su AS (SELECT * REPLACE (last_day(CAST(formation_date - INTERVAL 1 MONTH AS DATE)) AS formation_date) FROM utargets)""",
    walk_sql("st"), walk_sql("su", p="u"),
    "y AS (SELECT s.date, s.gross, s.turnover, u.gross AS universe_ew FROM s_month s JOIN u_month u USING (sleeve, date))"))
def p13(spark, sf):
    return present(run_backtest(panel(spark, sf), SHIFTED).monthly, "date:d gross:9 universe_ew:9 turnover:9")


# ---------------------------------------------------------------- supplied scores, upper bound
START_RET = f"""
sret AS (SELECT * FROM ret WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
pret AS (SELECT * FROM sret),
pbench AS (SELECT * FROM bench WHERE date BETWEEN DATE '{START}' AND DATE '{END}')"""
# the score table: the return of the following month, known only with hindsight, so it is an upper bound
HINDSIGHT = """
hind AS (SELECT security_id, date, lead(total_return) OVER (PARTITION BY security_id ORDER BY date) AS score FROM ret)"""
SUPPLIED = [PANEL_SQL, START_RET, HINDSIGHT, form_sql(3),
            "sec AS (SELECT f.sleeve, f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date)",
            universe_sql(src="sec"), """
ranked AS (SELECT u.*, row_number() OVER (PARTITION BY formation_date ORDER BY h.score DESC, u.security_id) AS rank
           FROM uni u JOIN hind h ON h.security_id = u.security_id AND h.date = u.formation_date WHERE h.score IS NOT NULL)""",
            *BOOKS]
SUPPLIED_LAYOUT = "date:d gross:9 net:9 turnover:9 cost:9 n_holdings:i universe_ew:9"


def hindsight(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("security_id").orderBy("date")
    return returns(spark, sf).select("security_id", "date", F.lead("total_return").over(w).alias("score"))


@register("p14_supplied_scores", sql(SUPPLIED_LAYOUT, "y", *SUPPLIED, """
y AS (SELECT s.*, u.gross AS universe_ew FROM s_month s LEFT JOIN u_month u USING (sleeve, date))"""))
def p14(spark, sf):
    return present(run_scores(panel(spark, sf, filings=False), hindsight(spark, sf), SPEC), SUPPLIED_LAYOUT)


@register("t02_lowest_scores", sql(SUPPLIED_LAYOUT, "y", *[c.replace("h.score DESC", "h.score ASC") for c in SUPPLIED], """
y AS (SELECT s.*, u.gross AS universe_ew FROM s_month s LEFT JOIN u_month u USING (sleeve, date))"""))
def t02(spark, sf):
    return present(run_scores(panel(spark, sf, filings=False), hindsight(spark, sf), SPEC, higher_is_better=False), SUPPLIED_LAYOUT)


# ---------------------------------------------------------------- deciles
DEC_CTE = f"""
dec AS (SELECT *, CAST(greatest(least(10 - ceil(rank / max(rank) OVER (PARTITION BY formation_date)::DOUBLE * 10) + 1, 10), 1) AS INT) AS decile
        FROM ranked),
dtargets AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY decile, formation_date) AS weight FROM dec),
dform AS (SELECT DISTINCT decile, formation_date FROM dec)"""
DECILES = [*RUN, DEC_CTE, windows_sql("dform", "decile", "dwins"), walk_sql("dtargets", "decile", "dwins", "d")]


@register("w09_decile_assignment", sql("formation_date:d security_id rank:i decile:i", "dec", *RANKED, DEC_CTE))
def w09(spark, sf):
    return present(decile_assignments(score(panel(spark, sf), SPEC).rankings), "formation_date:d security_id rank:i decile:i")


@register("p16_decile_returns", sql("decile:i date:d gross:9", "d_month", *DECILES))
def p16(spark, sf):
    return present(decile_returns(score(panel(spark, sf), SPEC)), "decile:i date:d gross:9")


def two_markets(spark, sf, filings=True):
    """Two markets with the same securities; in the second one returns are halved and turned around."""
    p = panel(spark, sf, filings)
    one = [t.withColumn("panel_id", F.lit(1)) for t in (p.returns, p.fundamentals, p.benchmarks)]
    two = [t.withColumn("panel_id", F.lit(2)) for t in (p.returns.withColumn("total_return", -0.5 * F.col("total_return")),
                                                        p.fundamentals, p.benchmarks)]
    return Panel(*[a.unionByName(b) for a, b in zip(one, two)])


def two_markets_sql(one: str) -> str:
    """The same SQL for both markets; benchmarks are those of the first."""
    other = one.replace(BENCH_SQL, BENCH_SQL.replace("FROM ret ", "FROM first_ret ").replace("JOIN ret ", "JOIN first_ret "))
    other = other.replace(RET_SQL, TURNED_SQL)
    return f"SELECT CAST(1 AS BIGINT) AS panel_id, * FROM ({one}) UNION ALL SELECT CAST(2 AS BIGINT), * FROM ({other})"


# the second market's returns; its benchmarks are still computed from the first one's
TURNED_SQL = RET_SQL.replace("\nret AS", "\nfirst_ret AS") + """,
ret AS (SELECT * REPLACE (-0.5::DOUBLE * total_return AS total_return) FROM first_ret)"""
MARKETS_LAYOUT = "panel_id:i decile:i date:d gross:9"
_ONE_MARKET = sql("decile:i date:d gross:9", "d_month", *DECILES)
_OTHER_MARKET = _ONE_MARKET.replace("0.1::DOUBLE * (px / prev - 1)", "-0.05::DOUBLE * (px / prev - 1)").replace(
    "-0.6::DOUBLE", "0.3::DOUBLE")


@register("p16_deciles_many_markets", f"""SELECT CAST(1 AS BIGINT) AS panel_id, * FROM ({_ONE_MARKET})
UNION ALL SELECT CAST(2 AS BIGINT), * FROM ({_OTHER_MARKET})""")
def p16_markets(spark, sf):
    return present(decile_returns(score(two_markets(spark, sf), SPEC, panel_keys=["panel_id"])), MARKETS_LAYOUT)


ANNUAL = replace(SPEC, frequency="annual")


@register("p16_deciles_at_finer_cadence", sql("decile:i date:d gross:9", "d_month", *DECILES))
def p16_finer(spark, sf):
    return present(decile_returns(decile_scored(panel(spark, sf), ANNUAL)), "decile:i date:d gross:9")


def cagr_sql(x: str) -> str:
    return (f"CASE WHEN count({x}) > 0 THEN CASE WHEN product(1 + {x}) > 0 THEN power(product(1 + {x}), 12.0::DOUBLE / count({x})) - 1 "
            "ELSE -1 END END")


def excess_sql(a: str, b: str) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN "
    return f"({cagr_sql(both + a + ' END')}) - ({cagr_sql(both + b + ' END')})"


def t_sql(a: str, b: str) -> str:
    d = f"({a} - {b})"
    return f"CASE WHEN count({d}) > 2 AND stddev_samp({d}) > 0 THEN avg({d}) / stddev_samp({d}) * sqrt(count({d})) END"


DEC_TABLE = f"""
dtab AS (SELECT d.decile, {cagr_sql('d.gross')} AS cagr, ({cagr_sql('d.gross')}) - ({cagr_sql('m.universe_ew')}) AS excess,
                {t_sql('d.gross', 'm.universe_ew')} AS t
         FROM d_month d LEFT JOIN monthly m USING (date) GROUP BY d.decile)"""


def _decile_parts(spark, sf):
    res = run_backtest(panel(spark, sf), SPEC)
    dr = decile_returns(res.scored)
    return dr, decile_table(dr, res.monthly)


@register("a18_decile_table", sql("decile:i cagr:8 excess:8 t:7", "dtab", *DECILES, DEC_TABLE))
def a18(spark, sf):
    return present(_decile_parts(spark, sf)[1], "decile:i cagr:8 excess:8 t:7")


DEC_SUM = f"""
dsum AS (SELECT corr(decile, rk) AS spearman, sum((up > 0)::INT) AS monotone_steps, arg_max(decile, cagr) = 10 AS top_is_best
         FROM (SELECT *, rank() OVER (ORDER BY cagr) AS rk, cagr - lag(cagr) OVER (ORDER BY decile) AS up FROM dtab)),
dend AS (SELECT ({cagr_sql('a.gross')}) - ({cagr_sql('b.gross')}) AS top_minus_bottom_annual, {t_sql('a.gross', 'b.gross')} AS top_minus_bottom_t
         FROM (SELECT * FROM d_month WHERE decile = 10) a FULL JOIN (SELECT * FROM d_month WHERE decile = 1) b USING (date)),
y AS (SELECT * FROM dsum, dend)"""
DSUM_LAYOUT = "spearman:8 monotone_steps:i top_is_best top_minus_bottom_annual:8 top_minus_bottom_t:7"


@register("a18_decile_summary", sql(DSUM_LAYOUT, "y", *DECILES, DEC_TABLE, DEC_SUM))
def a18_summary(spark, sf):
    dr, table = _decile_parts(spark, sf)
    return present(decile_summary(dr, table), DSUM_LAYOUT)


# ---------------------------------------------------------------- luck
SEEDS = 30
NULL_CTES = [PANEL_SQL, START_RET, form_sql(3),
             "sec AS (SELECT f.sleeve, f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date)",
             universe_sql(src="sec"), f"""
ranked AS (SELECT u.*, panel_id, row_number() OVER (PARTITION BY panel_id, formation_date ORDER BY
              substr(md5(panel_id || '|' || CAST(formation_date AS VARCHAR) || '|' || security_id), 1, 12) DESC, security_id) AS rank
           FROM uni u, range(1000, {1000 + SEEDS}) p(panel_id))""",
             windows_sql(), COST_CTE, targets_sql(SPEC.top_n, part="panel_id, formation_date"),
             f"nform AS (SELECT DISTINCT panel_id, formation_date FROM ranked)", windows_sql("nform", "panel_id", "nwins"),
             walk_sql("targets", "panel_id", "nwins", "n"), UNI_TARGETS, walk_sql("utargets", p="u"), f"""
runs AS (SELECT n.panel_id, {cagr_sql('n.net')} AS cagr, {excess_sql('n.net', 'u.gross')} AS excess_vs_universe_ew,
                {excess_sql('n.net', 'b.market_ew_return')} AS excess_vs_market_ew,
                {excess_sql('n.net', 'b.sp500_total_return')} AS excess_vs_sp500,
                {t_sql('n.net', 'u.gross')} AS t_stat_vs_universe_ew,
                avg(n.net - b.risk_free_rate) / stddev_samp(n.net - b.risk_free_rate) * sqrt(12) AS sharpe
         FROM n_month n JOIN u_month u USING (date) JOIN pbench b USING (date) GROUP BY n.panel_id)"""]
RUNS_LAYOUT = ("panel_id:i cagr:8 excess_vs_universe_ew:8 excess_vs_market_ew:8 excess_vs_sp500:8 t_stat_vs_universe_ew:7 sharpe:7")


def null_runs(spark, sf):
    p = panel(spark, sf, filings=False)
    monthly = run_scores(p, lambda members: shuffled_scores(members, SEEDS), SPEC, keys=["panel_id"])
    return panel_metrics(monthly.join(p.benchmarks, "date"))


@register("p17_null_panels", sql(RUNS_LAYOUT, "runs", *NULL_CTES))
def p17(spark, sf):
    return present(null_runs(spark, sf), RUNS_LAYOUT)


NULL_LONG = "\nlongs AS (UNPIVOT (SELECT * EXCLUDE (panel_id, cagr) FROM runs) ON COLUMNS(*) INTO NAME metric VALUE value)"
SUMMARY_LAYOUT = "metric n:i mean:8 std:8 p1:8 p5:8 p10:8 p25:8 p50:8 p75:8 p90:8 p95:8 p99:8"
NULL_SUM = "\nnsum AS (SELECT metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, " + ", ".join(
    f"quantile_cont(value, {p / 100}) AS p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + " FROM longs GROUP BY metric)"


@register("a19_null_summary", sql(SUMMARY_LAYOUT, "nsum", *NULL_CTES, NULL_LONG, NULL_SUM))
def a19(spark, sf):
    return present(null_summary(null_values(null_runs(spark, sf))), SUMMARY_LAYOUT)


PLACE_LAYOUT = "run_id:i metric value:8 percentile:6 z:6 n:i verdict available"


@register("a20_placement", sql(PLACE_LAYOUT, "y", *NULL_CTES, NULL_LONG, NULL_SUM, """
probe AS (SELECT panel_id AS run_id, 'excess_vs_universe_ew' AS metric, excess_vs_universe_ew + 0.01::DOUBLE * (panel_id % 4) AS value FROM runs),
pos AS (SELECT p.*, n, (p.value - mean) / std AS z,
               100.0::DOUBLE * (SELECT count(*) FROM longs l WHERE l.metric = p.metric AND l.value < p.value) / n AS percentile
        FROM probe p JOIN nsum USING (metric)),
y AS (SELECT *, true AS available, CASE WHEN percentile >= 99 THEN 'p99' WHEN percentile >= 95 THEN 'p95'
             WHEN percentile >= 90 THEN 'p90' ELSE 'inside' END AS verdict
      FROM pos)"""))
def a20(spark, sf):
    runs = materialize(null_runs(spark, sf))
    probe = runs.select(F.col("panel_id").alias("run_id"), F.lit("excess_vs_universe_ew").alias("metric"),
                        (F.col("excess_vs_universe_ew") + 0.01 * F.pmod("panel_id", F.lit(4))).alias("value"))
    return present(placement(probe, null_values(runs)), PLACE_LAYOUT)


BAR_LAYOUT = "n_trials:i expected_best_of_n:8 significance_bar:8 single_trial_bar:8"


@register("a21_testing_bar", sql(BAR_LAYOUT, "y", *NULL_CTES, NULL_LONG, """
srt AS (SELECT list(value ORDER BY value) AS v FROM longs WHERE metric = 'excess_vs_universe_ew'),
probs AS (SELECT n_trials, unnest([n_trials / (n_trials + 1), power(0.95, 1 / n_trials), 0.95]) AS p, unnest([1, 2, 3]) AS k
          FROM (SELECT DISTINCT panel_id - 999.0::DOUBLE AS n_trials FROM runs)),
vals AS (SELECT n_trials, k, v[CAST(floor(p * (len(v) - 1)) AS BIGINT) + 1] + (v[least(CAST(floor(p * (len(v) - 1)) AS BIGINT) + 2, len(v))]
           - v[CAST(floor(p * (len(v) - 1)) AS BIGINT) + 1]) * (p * (len(v) - 1) - floor(p * (len(v) - 1))) AS q FROM probs, srt),
y AS (SELECT n_trials, max(q) FILTER (k = 1) AS expected_best_of_n, max(q) FILTER (k = 2) AS significance_bar,
             max(q) FILTER (k = 3) AS single_trial_bar FROM vals GROUP BY n_trials)"""))
def a21(spark, sf):
    runs = materialize(null_runs(spark, sf))
    trials = runs.select((F.col("panel_id") - 999).alias("n_trials"))
    return present(multiple_testing_bar(trials, null_values(runs)), BAR_LAYOUT)


FRACTION_LAYOUT = "excess_strategy:8 excess_oracle:8 excess_vs_oracle:8 fraction_of_oracle:7"


@register("p15_fraction_of_bound", sql(FRACTION_LAYOUT, "y", *SUPPLIED,
          "hform AS (SELECT * FROM form)", "nret AS (SELECT 1)", """
worse AS (SELECT u.*, row_number() OVER (PARTITION BY formation_date ORDER BY 0.4 * h.score + ((u.sic_code * 7919) % 1000) / 10000.0::DOUBLE DESC, u.security_id) AS rank
          FROM uni u JOIN hind h ON h.security_id = u.security_id AND h.date = u.formation_date WHERE h.score IS NOT NULL)""",
          targets_sql(10, "wtargets", src="worse"), walk_sql("wtargets", p="w"), f"""
j AS (SELECT w.net, s.net AS oracle_net, u.gross AS universe_ew FROM w_month w JOIN s_month s USING (sleeve, date) JOIN u_month u USING (sleeve, date)),
e AS (SELECT {excess_sql('net', 'universe_ew')} AS excess_strategy, {excess_sql('oracle_net', 'universe_ew')} AS excess_oracle,
             {excess_sql('net', 'oracle_net')} AS excess_vs_oracle FROM j),
y AS (SELECT *, CASE WHEN excess_oracle > 0.005 THEN excess_strategy / excess_oracle END AS fraction_of_oracle FROM e)"""))
def p15(spark, sf):
    p, best = panel(spark, sf, filings=False), hindsight(spark, sf)
    noise = p.returns.select("security_id", "date", (F.pmod(F.col("sic_code") * 7919, F.lit(1000)) / 10000).alias("noise"))
    weaker = (best.join(noise, ["security_id", "date"])
              .select("security_id", "date", (F.lit(0.4) * F.col("score") + F.col("noise")).alias("score")))
    bound = run_scores(p, best, SPEC).select("date", F.col("net").alias("oracle_net"), "universe_ew")
    own = run_scores(p, weaker, SPEC).select("date", "net")
    return present(oracle_fraction(own.join(bound, "date")), FRACTION_LAYOUT)
