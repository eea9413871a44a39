"""Contract checks, leakage audits, forward returns, quantile groups and the run log."""
from __future__ import annotations

from pyspark.sql import functions as F

from pitrank.analytics.nulls import null_values, panel_metrics, placement, sweep_summary
from pitrank.analytics.runlog import count_runs, latest_runs
from pitrank.audits import contract as C
from pitrank.audits import leakage as L
from pitrank.functions.lineage import materialize
from pitrank.functions.stats import excess_cagr
from pitrank.operators.ranking import RankingSpec, percent_rank_average, quantile_bucket
from pitrank.operators.schedule import rebalance_dates
from pitrank.operators.snapshot import cross_sections
from pitrank.operators.trailing import forward_returns
from pitrank.operators.universe import select_universe
from pitrank.plans.backtest import run_scores
from pitrank.sources.canonical import month_ends, prepare_panel

from .common import columns_sql, present, register, sql
from .core import (BASE, END, MAGIC, RANKED, SNAP_SQL, SPEC, START, _values, asof_sql, avg_rank_sql, form_sql, rank_sum_sql,
                   universe_sql, values_sql)
from .panel import FUND_SQL, PANEL_SQL, RET_SQL, fundamentals, panel, returns, table
from .portfolios import HINDSIGHT, NULL_CTES, SUPPLIED, excess_sql, hindsight, null_runs


def fwd_sql(h: int, src: str = "pret", name: str = "fwd") -> str:
    return f"""
{name} AS (SELECT security_id, date, CASE WHEN count(total_return) OVER w > 0 THEN exp(sum(ln(1 + greatest(total_return, -0.999::DOUBLE))) OVER w) - 1 END AS fwd
        FROM {src} WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING))"""


@register("w11_forward_returns", sql("security_id date:d fwd:9", "fwd", RET_SQL, fwd_sql(3, "ret")))
def w11(spark, sf):
    return present(forward_returns(returns(spark, sf), 3), "security_id date:d fwd:9")


def _parts(spark, sf, freq="quarterly"):
    p = panel(spark, sf)
    cut = prepare_panel(p, START, END)
    dates = materialize(rebalance_dates(month_ends(cut.returns, START), freq, 12).select("formation_date"))
    return cut, dates


def qcut_sql(src: str, name: str, q: int = 10, keys: str = "date") -> str:
    """Equal-frequency groups through the edges of the positions, as the definition states them."""
    return f"""
{name}_0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score, security_id) AS p, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
{name} AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(CAST(ceil((p - 1) * {q} / (n - 1)::DOUBLE) AS INT) - 1, 0) END AS decile FROM {name}_0)"""


SCORES = """
sc AS (SELECT r.security_id, r.formation_date AS date, count(*) OVER (PARTITION BY formation_date) + 1 - r.rank AS score FROM ranked r),
sf AS (SELECT sc.*, fwd.fwd FROM sc JOIN fwd USING (security_id, date) WHERE fwd IS NOT NULL)"""


@register("w10_j16_score_deciles", sql("security_id date:d decile:i fwd:9", "dq", *RANKED, fwd_sql(3), SCORES, qcut_sql("sf", "dq")))
def w10(spark, sf):
    cut, dates = _parts(spark, sf)
    s = L.scores_at(cut.returns, cut.fundamentals, dates, RankingSpec(MAGIC))
    return present(L.score_deciles(s, forward_returns(cut.returns, 3)), "security_id date:d decile:i fwd:9")


@register("w10_score_deciles_unbounded_group", sql("security_id date:d decile:i", "dq", RET_SQL, fwd_sql(3, "ret"), """
sf AS (SELECT r.security_id, r.date, r.market_cap AS score, fwd FROM ret r JOIN fwd USING (security_id, date) WHERE fwd IS NOT NULL)""",
                                                             qcut_sql("sf", "dq")))
def w10_wide(spark, sf):
    r = materialize(returns(spark, sf))
    scores = r.select("security_id", "date", F.col("market_cap").alias("score"))
    return present(L.score_deciles(scores, forward_returns(r, 3), bounded=False), "security_id date:d decile:i")


@register("a24_decile_means", sql("decile:i mean_fwd:8 n:i", "y", *RANKED, fwd_sql(3), SCORES, qcut_sql("sf", "dq"),
                                  "y AS (SELECT decile, avg(fwd) AS mean_fwd, count(*) AS n FROM dq GROUP BY decile)"))
def a24(spark, sf):
    cut, dates = _parts(spark, sf)
    s = L.scores_at(cut.returns, cut.fundamentals, dates, RankingSpec(MAGIC))
    return present(L.decile_means(L.score_deciles(s, forward_returns(cut.returns, 3))), "decile:i mean_fwd:8 n:i")


@register("w18_terciles", sql("security_id tercile:i", "y", FUND_SQL, """
md AS (SELECT security_id, median(ebit_ttm / total_assets) AS score, 1 AS date FROM fund WHERE total_assets > 0 GROUP BY security_id)""",
                              qcut_sql("md", "tq", 3), "y AS (SELECT security_id, decile AS tercile FROM tq)"))
def w18(spark, sf):
    from pitrank.functions.positions import ordered_positions
    f = fundamentals(spark, sf).where("total_assets > 0")
    med = f.groupBy("security_id").agg(F.percentile(F.col("ebit_ttm") / F.col("total_assets"), F.lit(0.5)).alias("score"))
    pos = ordered_positions(materialize(med.withColumn("_g", F.lit(1))), ["_g"], ["score", "security_id"])
    return present(pos.withColumn("tercile", quantile_bucket(F.col("n_before") + 1, F.col("n_total"), 3)), "security_id tercile:i")


@register("w17_percent_rank_composite", sql("formation_date:d security_id comp:8", "y", *BASE, form_sql(3), SNAP_SQL, universe_sql(), values_sql(MAGIC), f"""
y AS (SELECT formation_date, security_id,
             0.5 * ({avg_rank_sql('earnings_yield', False)}) / count(earnings_yield) OVER (PARTITION BY formation_date)
             + 0.5 * ({avg_rank_sql('return_on_capital', False)}) / count(return_on_capital) OVER (PARTITION BY formation_date) AS comp FROM vals)"""))
def w17(spark, sf):
    v = _values(spark, sf, list(MAGIC))
    g = ["formation_date"]
    comp = 0.5 * percent_rank_average("earnings_yield", g) + 0.5 * percent_rank_average("return_on_capital", g)
    return present(v.withColumn("comp", comp), "formation_date:d security_id comp:8")


# ---------------------------------------------------------------- contract
def spoiled_returns(spark, sf):
    """Returns with mistakes added on purpose: doubled rows, a second delisting, a date off the month end."""
    r = returns(spark, sf)
    odd = F.pmod("sic_code", F.lit(13))
    return (r.unionByName(r.where(odd == 4))
            .withColumn("date", F.when(odd == 7, F.date_sub("date", 3)).otherwise(F.col("date")))
            .withColumn("is_delisted_this_month", F.col("is_delisted_this_month") | ((odd == 9) & (F.month("date") == 2))))


SPOILED = """
sp AS (SELECT * REPLACE (CASE WHEN sic_code % 13 = 7 THEN date - 3 ELSE date END AS date,
                         is_delisted_this_month OR (sic_code % 13 = 9 AND month(date) = 2) AS is_delisted_this_month)
       FROM (SELECT * FROM ret UNION ALL SELECT * FROM ret WHERE sic_code % 13 = 4)),
lst AS (SELECT security_id, max(date) AS last_date FROM sp GROUP BY 1)"""


@register("q02_q03_q04_returns_contract", sql("rule violations:i", "y", RET_SQL, SPOILED, """
y AS (SELECT 'month_end' AS rule, count(*) AS violations FROM sp WHERE date <> last_day(date)
      UNION ALL SELECT 'unique_key', count(*) FROM (SELECT 1 FROM sp GROUP BY security_id, date HAVING count(*) > 1)
      UNION ALL SELECT 'one_delisting', count(*) FROM (SELECT 1 FROM sp WHERE is_delisted_this_month GROUP BY security_id HAVING count(*) > 1)
      UNION ALL SELECT 'delisting_is_last', count(*) FROM (SELECT security_id, max(date) AS d FROM sp WHERE is_delisted_this_month GROUP BY 1) JOIN lst USING (security_id) WHERE d <> last_date)"""))
def q02(spark, sf):
    return present(C.returns_violations(spoiled_returns(spark, sf)), "rule violations:i")


@register("q03_u07_duplicate_keys", sql("security_id date:d n:i", "y", RET_SQL, SPOILED,
                                        "y AS (SELECT security_id, date, count(*) AS n FROM sp GROUP BY ALL HAVING count(*) > 1)"))
def q03(spark, sf):
    return present(C.duplicate_keys(spoiled_returns(spark, sf), ["security_id", "date"]), "security_id date:d n:i")


@register("q05_q06_fundamentals_contract", sql("rule violations:i", "y", FUND_SQL, """
fs AS (SELECT * REPLACE (CASE WHEN total_assets > 1e8 THEN fiscal_period_end - 1 ELSE available_date END AS available_date) FROM fund),
y AS (SELECT 'published_after_period' AS rule, count(*) AS violations FROM fs WHERE available_date < fiscal_period_end
      UNION ALL SELECT 'unique_key', count(*) FROM (SELECT 1 FROM fs GROUP BY security_id, fiscal_period_end, available_date HAVING count(*) > 1))"""))
def q05(spark, sf):
    f = fundamentals(spark, sf).withColumn("available_date", F.when(F.col("total_assets") > 1e8, F.date_sub("fiscal_period_end", 1))
                                           .otherwise(F.col("available_date")))
    return present(C.fundamentals_violations(f), "rule violations:i")


@register("q07_benchmarks_contract", sql("rule violations:i", "y", PANEL_SQL, """
y AS (SELECT 'month_end' AS rule, count(*) AS violations FROM bench WHERE date <> last_day(date)
      UNION ALL SELECT 'unique_key', count(*) FROM (SELECT 1 FROM bench GROUP BY date HAVING count(*) > 1))"""))
def q07(spark, sf):
    return present(C.benchmarks_violations(panel(spark, sf, filings=False).benchmarks), "rule violations:i")


@register("q08_contract_counts", sql("table_name n_rows:i n_securities:i date_min:d date_max:d", "y", PANEL_SQL, """
y AS (SELECT 'returns' AS table_name, count(*) AS n_rows, count(DISTINCT security_id) AS n_securities, min(date) AS date_min, max(date) AS date_max FROM ret
      UNION ALL SELECT 'fundamentals', count(*), count(DISTINCT security_id), min(available_date), max(available_date) FROM fund
      UNION ALL SELECT 'benchmarks', count(*), 0, min(date), max(date) FROM bench)"""))
def q08(spark, sf):
    return present(C.contract_counts(panel(spark, sf)), "table_name n_rows:i n_securities:i date_min:d date_max:d")


# ---------------------------------------------------------------- leakage
def spread_sql(src: str) -> str:
    return f"""SELECT avg(fwd) FILTER (decile = 9) - avg(fwd) FILTER (decile = 0) AS spread, avg(fwd) FILTER (decile = 9) AS top_decile, count(*) AS n FROM {src}"""


def variant_sql(tag: str, snap: str) -> str:
    """Universe, ranking, deciles for one variant; every CTE name carries the tag."""
    return ",".join([snap, universe_sql(src=f"snap_{tag}", name=f"uni_{tag}"), values_sql(MAGIC, f"uni_{tag}", f"vals_{tag}"),
                     rank_sum_sql(MAGIC, f"vals_{tag}", f"ranked_{tag}"), f"""
sf_{tag} AS (SELECT r.security_id, r.formation_date AS date, -r.rank AS score, fwd FROM ranked_{tag} r JOIN fwd ON fwd.security_id = r.security_id
             AND fwd.date = r.formation_date WHERE fwd IS NOT NULL)""", qcut_sql(f"sf_{tag}", f"dq_{tag}")])


def simple_snap(tag: str, col: str) -> str:
    return asof_sql(f"now_{tag}", col=col) + f""",
snap_{tag} AS (SELECT c.*, f.formation_date, n.* EXCLUDE (formation_date, security_id, available_date) FROM form f JOIN pret c ON c.date = f.formation_date
               LEFT JOIN now_{tag} n ON n.formation_date = c.date AND n.security_id = c.security_id)"""


SPREAD_LAYOUT = "variant spread:8 top_decile:8 n:i"


@register("q10_lookahead_audit", sql(SPREAD_LAYOUT, "y", *BASE, form_sql(3), fwd_sql(3), variant_sql("a", simple_snap("a", "available_date")),
          variant_sql("b", simple_snap("b", "fiscal_period_end")),
          f"y AS (SELECT 'correct' AS variant, * FROM ({spread_sql('dq_a')}) UNION ALL SELECT 'lookahead', * FROM ({spread_sql('dq_b')}))"))
def q10(spark, sf):
    cut, dates = _parts(spark, sf)
    return present(L.lookahead_audit(cut.returns, cut.fundamentals, dates, RankingSpec(MAGIC), forward_returns(cut.returns, 3)), SPREAD_LAYOUT)


FILL_SQL = """
fp AS (SELECT security_id, fiscal_period_end, ebit_ttm FROM pfund QUALIFY row_number() OVER (PARTITION BY security_id, fiscal_period_end ORDER BY available_date) = 1),
grid AS (SELECT security_id, last_day(CAST(unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) AS DATE)) AS fiscal_period_end
         FROM (SELECT security_id, date_trunc('month', min(fiscal_period_end)) AS lo, date_trunc('month', max(fiscal_period_end)) AS hi FROM fp GROUP BY 1)),
inv AS (SELECT g.security_id, g.fiscal_period_end, g.fiscal_period_end + 60 AS available_date,
               (SELECT arg_min(n.ebit_ttm, n.fiscal_period_end) FROM fp n WHERE n.security_id = g.security_id AND n.fiscal_period_end > g.fiscal_period_end) AS ebit_ttm
        FROM grid g ANTI JOIN fp USING (security_id, fiscal_period_end)),
wrong AS (SELECT security_id, fiscal_period_end, available_date, ebit_ttm FROM pfund UNION ALL SELECT * FROM inv)"""
BACKFILL = [*BASE, form_sql(1), fwd_sql(3), FILL_SQL, asof_sql("good"), asof_sql("bad", src="wrong"),
            "sec AS (SELECT f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date)", universe_sql(src="sec"), """
chg AS (SELECT u.formation_date, u.security_id, ln(greatest(b.ebit_ttm, 1) / greatest(g.ebit_ttm, 1)) AS leak, fwd.fwd
        FROM uni u JOIN good g USING (formation_date, security_id) JOIN bad b USING (formation_date, security_id)
        JOIN fwd ON fwd.security_id = u.security_id AND fwd.date = u.formation_date
        WHERE g.fiscal_period_end <> b.fiscal_period_end AND fwd.fwd IS NOT NULL)"""]


@register("q11_backfilled_quarters", sql("security_id fiscal_period_end:d available_date:d ebit_ttm:2", "inv", *BASE, FILL_SQL))
def q11_rows(spark, sf):
    cut = prepare_panel(panel(spark, sf), START, END)
    return present(L.backfilled_quarters(cut.fundamentals), "security_id fiscal_period_end:d available_date:d ebit_ttm:2")


@register("q11_j17_backfill_changes", sql("formation_date:d security_id leak:7 fwd:8", "chg", *BACKFILL))
def q11_changes(spark, sf):
    cut, dates = _parts(spark, sf, "monthly")
    return present(L.backfill_changes(cut.returns, cut.fundamentals, dates, forward_returns(cut.returns, 3)), "formation_date:d security_id leak:7 fwd:8")


@register("q11_backfill_audit", sql("n_up:i n_down:i mean_up:8 mean_down:8 gap:8", "y", *BACKFILL, """
y AS (SELECT count(*) FILTER (leak > 0) AS n_up, count(*) FILTER (leak < 0) AS n_down, avg(fwd) FILTER (leak > 0) AS mean_up,
             avg(fwd) FILTER (leak < 0) AS mean_down, avg(fwd) FILTER (leak > 0) - avg(fwd) FILTER (leak < 0) AS gap FROM chg)"""))
def q11(spark, sf):
    cut, dates = _parts(spark, sf, "monthly")
    return present(L.backfill_audit(L.backfill_changes(cut.returns, cut.fundamentals, dates, forward_returns(cut.returns, 3))),
                   "n_up:i n_down:i mean_up:8 mean_down:8 gap:8")


SURV_LAYOUT = "variant n:i mean_fwd:8 n_die_within_year:i"


@register("q12_j18_survivorship_audit", sql(SURV_LAYOUT, "y", *RANKED, fwd_sql(3), """
ldt AS (SELECT security_id, max(date) AS last_date FROM pret GROUP BY 1),
death AS (SELECT security_id, date AS death FROM pret WHERE is_delisted_this_month)""",
          "vals_s AS (SELECT vals.* FROM vals JOIN ldt USING (security_id) WHERE last_date >= CAST(formation_date + INTERVAL 12 MONTH AS DATE))",
          rank_sum_sql(MAGIC, "vals_s", "ranked_s"), """
both_ AS (SELECT 'correct' AS variant, security_id, formation_date FROM ranked UNION ALL SELECT 'survivors', security_id, formation_date FROM ranked_s),
y AS (SELECT variant, count(*) AS n, avg(fwd) AS mean_fwd,
             count(*) FILTER (death > formation_date AND death < CAST(formation_date + INTERVAL 12 MONTH AS DATE)) AS n_die_within_year
      FROM both_ b LEFT JOIN fwd ON fwd.security_id = b.security_id AND fwd.date = b.formation_date LEFT JOIN death d ON d.security_id = b.security_id GROUP BY variant)"""))
def q12(spark, sf):
    cut, dates = _parts(spark, sf)
    return present(L.survivorship_audit(cut.returns, cut.fundamentals, dates, RankingSpec(MAGIC), forward_returns(cut.returns, 3)), SURV_LAYOUT)


def mom_sql(tag: str, lo: int, hi: int, need: int = 9) -> str:
    return f"""
mm_{tag} AS (SELECT a.security_id, a.date, CASE WHEN count(b.total_return) >= {need} THEN exp(sum(ln(1 + greatest(b.total_return, -0.999::DOUBLE)))) - 1 END AS mom
      FROM pret a JOIN pret b ON a.security_id = b.security_id AND (year(b.date) * 12 + month(b.date)) - (year(a.date) * 12 + month(a.date)) BETWEEN {lo} AND {hi}
      GROUP BY a.security_id, a.date),
sf_{tag} AS (SELECT u.security_id, u.formation_date AS date, mom AS raw, fwd, rank() OVER (PARTITION BY u.formation_date ORDER BY mom, u.security_id DESC) AS score
      FROM uni u JOIN mm_{tag} m ON m.security_id = u.security_id AND m.date = u.formation_date JOIN fwd ON fwd.security_id = u.security_id AND fwd.date = u.formation_date
      WHERE mom IS NOT NULL AND fwd IS NOT NULL),{qcut_sql(f'sf_{tag}', f'dq_{tag}')}"""


@register("q13_momentum_audit", sql(SPREAD_LAYOUT, "y", *BASE, form_sql(3), fwd_sql(1),
          "sec AS (SELECT f.formation_date, r.* FROM form f JOIN pret r ON r.date = f.formation_date)", universe_sql(src="sec"),
          mom_sql("a", -11, -1), mom_sql("b", -11, 0), mom_sql("c", -10, 1), f"""
y AS (SELECT 'skip_month' AS variant, * FROM ({spread_sql('dq_a')}) UNION ALL SELECT 'no_skip', * FROM ({spread_sql('dq_b')})
      UNION ALL SELECT 'future_month', * FROM ({spread_sql('dq_c')}))"""))
def q13(spark, sf):
    cut, dates = _parts(spark, sf)
    return present(L.momentum_audit(cut.returns, dates, forward_returns(cut.returns, 1)), SPREAD_LAYOUT)


@register("q15_truncation_invariance", sql("n_rows:i n_different:i", "y", RET_SQL, """
y AS (SELECT count(*) AS n_rows, 0 AS n_different FROM ret WHERE date = DATE '1999-06-30')"""))
def q15(spark, sf):
    day = spark.range(1).select(F.lit("1999-06-30").cast("date").alias("formation_date"))
    return present(L.truncation_audit(materialize(returns(spark, sf)), materialize(fundamentals(spark, sf)), day),
                   "n_rows:i n_different:i")


@register("q15_truncation_every_date", sql("formation_date:d n_rows:i n_different:i", "y", RET_SQL, """
y AS (SELECT date AS formation_date, count(*) AS n_rows, 0 AS n_different FROM ret GROUP BY date)"""))
def q15_every(spark, sf):
    """Every month of the panel in one job: nothing that is published later changes a snapshot."""
    return present(L.truncation_audit(materialize(returns(spark, sf)), materialize(fundamentals(spark, sf))),
                   "formation_date:d n_rows:i n_different:i")


@register("q17_quarter_gaps", sql("distressed n:i n_gaps:i gap_rate:8", "y", FUND_SQL, """
fp AS (SELECT * FROM fund QUALIFY row_number() OVER (PARTITION BY security_id, fiscal_period_end ORDER BY available_date) = 1),
g AS (SELECT coalesce(ebit_ttm < 0, false) OR coalesce(book_equity < 0, false) AS distressed,
             coalesce(fiscal_period_end - lag(fiscal_period_end) OVER (PARTITION BY security_id ORDER BY fiscal_period_end) > 100, false) AS gap FROM fp),
y AS (SELECT distressed, count(*) AS n, count(*) FILTER (gap) AS n_gaps, avg(gap::INT) AS gap_rate FROM g GROUP BY distressed)"""))
def q17(spark, sf):
    return present(L.quarter_gaps(fundamentals(spark, sf)), "distressed n:i n_gaps:i gap_rate:8")


@register("q18_restatements", sql("n_rows:i n_restated_rows:i restated_share:8 n_not_later:i", "y", FUND_SQL, """
d AS (SELECT count(*) OVER (PARTITION BY security_id, fiscal_period_end) AS k,
             available_date - lag(available_date) OVER (PARTITION BY security_id, fiscal_period_end ORDER BY available_date) AS step FROM fund),
y AS (SELECT count(*) AS n_rows, count(*) FILTER (k > 1) AS n_restated_rows, avg((k > 1)::INT) AS restated_share, count(*) FILTER (step <= 0) AS n_not_later FROM d)"""))
def q18(spark, sf):
    return present(L.restatements(fundamentals(spark, sf)), "n_rows:i n_restated_rows:i restated_share:8 n_not_later:i")


@register("a28_w16_survivor_returns", sql("all_ew:9 survivor_ew:9 survivor_deaths:i", "y", RET_SQL, """
l AS (SELECT *, max(date) OVER (PARTITION BY security_id) - date > 360 AS lives FROM ret),
m AS (SELECT avg(total_return) AS a, avg(total_return) FILTER (lives) AS s, count(*) FILTER (lives AND is_delisted_this_month) AS d FROM l GROUP BY date),
y AS (SELECT avg(a) AS all_ew, avg(s) AS survivor_ew, sum(d) AS survivor_deaths FROM m)"""))
def a28(spark, sf):
    return present(L.survivor_returns(returns(spark, sf)), "all_ew:9 survivor_ew:9 survivor_deaths:i")


CORR_LAYOUT = "win correlation:8 n:i"


@register("a29_announcement_correlation", sql(CORR_LAYOUT, "y", RET_SQL, FUND_SQL, """
fp AS (SELECT * FROM fund QUALIFY row_number() OVER (PARTITION BY security_id, fiscal_period_end ORDER BY available_date) = 1),
su AS (SELECT security_id, last_day(available_date) AS am, least(greatest((ebit_ttm - lag(ebit_ttm) OVER (PARTITION BY security_id ORDER BY fiscal_period_end))
              / greatest(abs(revenue_ttm), 1), -0.3), 0.3) AS x, lag(ebit_ttm) OVER (PARTITION BY security_id ORDER BY fiscal_period_end) AS pe FROM fp),
y AS (SELECT 'announcement' AS win, corr(x, total_return) AS correlation, count(*) AS n FROM su JOIN ret ON ret.security_id = su.security_id AND ret.date = am WHERE pe IS NOT NULL
      UNION ALL SELECT 'two_months_later', corr(x, total_return), count(*) FROM su JOIN ret ON ret.security_id = su.security_id
      AND ret.date = last_day(CAST(am + INTERVAL 2 MONTH AS DATE)) WHERE pe IS NOT NULL)"""))
def a29(spark, sf):
    r = materialize(returns(spark, sf))
    return present(L.announcement_correlation(r, fundamentals(spark, sf)).withColumnRenamed("window", "win"), CORR_LAYOUT)


# ---------------------------------------------------------------- run log and sweeps
def run_log(spark, sf):
    """The event stream read as a run log: the nested text column holds the configuration."""
    e = table(spark, sf, "events").withColumn("cfg", F.from_json("props", "k INT"))
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("name"), F.md5(F.col("cfg.k").cast("string")).alias("config_hash"),
                    F.lit("events").alias("source"), (F.col("value") / 100).alias("cagr_net"), F.lit(None).cast("double").alias("sharpe"),
                    (F.col("value") / 200).alias("excess_vs_universe_ew"), F.lit(50.0).alias("null_percentile"))


LOG_SQL = """
lg AS (SELECT ts AS timestamp, event_type AS name, md5(props->>'k') AS config_hash, value / 100 AS cagr_net, event_id FROM events)"""


@register("a22_run_counts", sql("n_runs:i n_trials:i", "y", LOG_SQL, "y AS (SELECT count(*) AS n_runs, count(DISTINCT config_hash) AS n_trials FROM lg)"))
def a22(spark, sf):
    return present(count_runs(run_log(spark, sf)), "n_runs:i n_trials:i")


@register("t05_latest_runs", sql("timestamp:d name config_hash cagr_net:6", "y", LOG_SQL,
                                 "y AS (SELECT * FROM lg ORDER BY timestamp DESC, config_hash DESC LIMIT 50)"))
def t05(spark, sf):
    return present(latest_runs(run_log(spark, sf)), "timestamp:d name config_hash cagr_net:6")


# ---------------------------------------------------------------- sweep
# The grid: how much of next month's return a score knows (strength), whether it is wrong about every second industry
# (trap), and five seeds of noise. All configurations are books of the same jobs.
STRENGTHS, TRAPS, N_SEEDS = 3, 2, 5
SWEEP_LAYOUT = ("trap:i strength:i decile_spread:8 oracle_excess:8 engine_excess:8 engine_excess_sd:8 engine_t_mean:7 "
                "seeds_above_null_p95:6 fraction_of_oracle_mean:7 n_seeds:i")
CONFIGS = f"""
cfg AS (SELECT t * 100 + s * 10 + k AS panel_id, t AS trap, s AS strength, k AS seed
        FROM range({TRAPS}) a(t), range({STRENGTHS}) b(s), range({N_SEEDS}) c(k)),
blend AS (SELECT c.*, u.*, CAST(('0x' || substr(md5(c.seed || '|' || CAST(u.formation_date AS VARCHAR) || '|' || u.security_id), 1, 12)) AS BIGINT)
                 / 281474976710656.0::DOUBLE + c.strength * 10.0::DOUBLE * (CASE WHEN c.trap = 1 AND u.sic_code % 2 = 0 THEN -h.score ELSE h.score END) AS x
          FROM uni u JOIN hind h ON h.security_id = u.security_id AND h.date = u.formation_date CROSS JOIN cfg c WHERE h.score IS NOT NULL)"""
_RANK_NULLS = next(c for c in NULL_CTES if "ranked AS" in c)
_BLENDED = HINDSIGHT + "," + CONFIGS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY panel_id, formation_date ORDER BY x DESC, security_id) AS rank FROM blend)"""


def _runs_of(ctes, last: str = "SELECT * FROM runs") -> str:
    return f"(WITH RECURSIVE {', '.join(ctes)} {last})"


_SWEPT = _runs_of([_BLENDED if c is _RANK_NULLS else c for c in NULL_CTES])
_SPREADS = _runs_of([*NULL_CTES[:NULL_CTES.index(_RANK_NULLS)], HINDSIGHT, CONFIGS, """
sf AS (SELECT panel_id, security_id, formation_date AS date, x AS score, h.score AS fwd FROM blend b
       JOIN hind h USING (security_id) WHERE h.date = b.formation_date)""", qcut_sql("sf", "dq", keys="panel_id, date")],
    "SELECT panel_id, avg(fwd) FILTER (decile = 9) - avg(fwd) FILTER (decile = 0) AS spread FROM dq GROUP BY panel_id")
_BOUND = _runs_of(SUPPLIED, f"SELECT {excess_sql('s.net', 'u.gross')} AS o FROM s_month s JOIN u_month u USING (sleeve, date)")


@register("a23_sweep_summary", f"""WITH nul AS {_runs_of(NULL_CTES)}, swept AS {_SWEPT}, spreads AS {_SPREADS}, bound AS {_BOUND},
st AS (SELECT panel_id // 100 AS trap, panel_id // 10 % 10 AS strength, excess_vs_universe_ew AS e, t_stat_vs_universe_ew AS t, spread, o,
              100.0 * (SELECT count(*) FROM nul WHERE nul.excess_vs_universe_ew < swept.excess_vs_universe_ew) / (SELECT count(*) FROM nul) AS pct
       FROM swept JOIN spreads USING (panel_id), bound),
y AS (SELECT trap, strength, avg(spread) AS decile_spread, avg(o) AS oracle_excess, avg(e) AS engine_excess, stddev_samp(e) AS engine_excess_sd,
             avg(t) AS engine_t_mean, avg((pct >= 95)::INT) AS seeds_above_null_p95, avg(CASE WHEN o > 0.005 THEN e / o END) AS fraction_of_oracle_mean,
             count(*) AS n_seeds FROM st GROUP BY trap, strength)
SELECT {columns_sql(SWEEP_LAYOUT)} FROM y""")
def a23(spark, sf):
    p = panel(spark, sf, filings=False)
    known = materialize(hindsight(spark, sf).where("score IS NOT NULL").select("security_id", "date", F.col("score").alias("_known")))
    config = ["trap", "strength", "seed"]

    def blended(members):
        """Every configuration's score of the universe's rows."""
        grid = members.join(known, ["security_id", "date"])
        for name, n in (("trap", TRAPS), ("strength", STRENGTHS), ("seed", N_SEEDS)):
            grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        text = F.concat_ws("|", F.col("seed").cast("string"), F.col("date").cast("string"), F.col("security_id"))
        noise = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(281474976710656.0)
        wrong = (F.col("trap") == 1) & (F.col("sic_code") % 2 == 0)
        signal = F.when(wrong, -F.col("_known")).otherwise(F.col("_known"))
        return grid.withColumn("score", noise + F.col("strength") * 10.0 * signal)

    codes = materialize(p.returns.select("security_id", "date", "sic_code"))
    monthly = run_scores(p, lambda members: blended(members.join(codes, ["security_id", "date"])), SPEC, keys=config)
    runs = materialize(panel_metrics(monthly.join(p.benchmarks, "date"), config))
    bound = run_scores(p, known.withColumnRenamed("_known", "score"), SPEC)
    best = materialize(bound.agg(excess_cagr("net", "universe_ew").alias("oracle_excess")))
    # the same scores, cut into tenths: what they say about the month that follows
    dates = rebalance_dates(month_ends(p.returns, START).where(F.col("date") <= F.lit(END).cast("date")), SPEC.frequency, SPEC.anchor_month)
    window = p.returns.where(F.col("date").between(F.lit(START).cast("date"), F.lit(END).cast("date")))
    members = select_universe(cross_sections(window, dates, trailing=False)).select("security_id", "date", "sic_code")
    scores = blended(members).select(*config, "security_id", "date", "score")
    spread = L.decile_spread(L.score_deciles(scores, known.withColumnRenamed("_known", "fwd"), keys=config), config)
    probe = runs.select(F.concat_ws("|", *config).alias("run_id"), F.lit("excess_vs_universe_ew").alias("metric"),
                        F.col("excess_vs_universe_ew").alias("value"))
    pct = placement(probe, null_values(null_runs(spark, sf))).select("run_id", F.col("percentile").alias("null_percentile"))
    oracle = best.first()["oracle_excess"]
    rows = (runs.withColumn("run_id", F.concat_ws("|", *config)).join(pct, "run_id").join(spread.select(*config, "spread"), config)
            .withColumn("oracle_excess", F.lit(oracle))
            .select(*config, F.col("spread").alias("decile_spread"), "oracle_excess", F.col("excess_vs_universe_ew").alias("engine_excess"),
                    F.col("t_stat_vs_universe_ew").alias("engine_t"), "null_percentile",
                    F.when(F.col("oracle_excess") > 0.005, F.col("excess_vs_universe_ew") / F.col("oracle_excess")).alias("fraction_of_oracle")))
    return present(sweep_summary(rows, ["trap", "strength"]), SWEEP_LAYOUT)
