"""Audits that run a deliberately wrong variant next to the right one and measure how much better it looks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import at_least, at_most, month_end_at, month_index, safe_div
from ..functions.lineage import materialize
from ..functions.positions import join_groups, ordered_positions
from ..operators.factors import compute_factors, required_columns
from ..operators.pit import PUBLIC, asof_fundamentals
from ..operators.ranking import RankingSpec, quantile_bucket, rank_stocks
from ..operators.snapshot import PRIOR, attach_fundamentals, build_snapshot, cross_sections
from ..operators.trailing import with_trailing
from ..operators.universe import UniverseRule, select_universe
from ..schemas import FUNDAMENTAL_VALUES, LOOKBACK_MONTHS, MAX_STALENESS_DAYS
from ..sources.landed import on_buckets, settings

DECILES = 10
# Versions are made after the shuffle, so a task's rows grow there; small partitions leave room for that.
BEFORE_VERSIONS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
                   "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k"}


def scores_at(returns: DataFrame, fundamentals: DataFrame, formations: DataFrame, ranking: RankingSpec,
              rule: UniverseRule = UniverseRule(), universe=None, asof_col: str = "available_date") -> DataFrame:
    """security_id, date, score (higher = better) of every ranked name; ``universe`` may replace the rule."""
    snap = build_snapshot(returns, fundamentals, formations, asof_col=asof_col, requires=required_columns(ranking.names),
                          universe=universe or (lambda s: select_universe(s, rule)))
    return scores_of(compute_factors(snap, ranking.names), ranking, rule)


def scores_of(values: DataFrame, ranking: RankingSpec, rule: UniverseRule = UniverseRule(),
              keys: Sequence[str] = ()) -> DataFrame:
    ranked = rank_stocks(values, ranking, keys=keys, bounded=rule.bounded)
    at = [*keys, "formation_date"]
    sizes = ranked.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    return join_groups(ranked, sizes, at).select(
        *keys, "security_id", F.col("formation_date").alias("date"),
        (F.col("_n") + 1 - F.col("rank")).cast("double").alias("score"))


def score_deciles(scores: DataFrame, forward: DataFrame, bounded: bool = True, ranges: int | None = None,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Scores with a forward return, cut into ten equal-frequency groups per keys and date (0 = lowest)."""
    rows = scores.join(forward.where(F.col("fwd").isNotNull()), ["security_id", "date"])
    if bounded:
        w = Window.partitionBy(*keys, "date")
        rows = (rows.withColumn("_p", F.row_number().over(w.orderBy("score", "security_id")))
                .withColumn("_n", F.count(F.lit(1)).over(w)))
    else:
        at = [*keys, "date"]
        pos = ordered_positions(rows, at, ["score", "security_id"], ranges)
        rows = rows.join(pos.select(*at, "security_id", (F.col("n_before") + 1).alias("_p"), F.col("n_total").alias("_n")),
                         [*at, "security_id"])
    return rows.withColumn("decile", quantile_bucket(F.col("_p"), F.col("_n"), DECILES)).drop("_p", "_n")


def decile_means(deciles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return deciles.groupBy(*keys, "decile").agg(F.avg("fwd").alias("mean_fwd"), F.count(F.lit(1)).alias("n"))


def decile_spread(deciles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forward return of the top decile minus the bottom decile."""
    top = F.avg(F.when(F.col("decile") == DECILES - 1, F.col("fwd")))
    bottom = F.avg(F.when(F.col("decile") == 0, F.col("fwd")))
    return deciles.groupBy(*keys).agg((top - bottom).alias("spread"), top.alias("top_decile"), F.count(F.lit(1)).alias("n"))


VARIANT = ["variant"]


def compare_spreads(values: DataFrame, ranking: RankingSpec, forward: DataFrame, rule: UniverseRule) -> DataFrame:
    """One row per variant. ``values`` holds the factor values of all variants, which are ranked, cut and averaged in one
    pass."""
    scores = scores_of(values, ranking, rule, VARIANT)
    bounded = rule.bounded
    return decile_spread(score_deciles(scores, forward, bounded, keys=VARIANT), VARIANT)


def sections_for(returns: DataFrame, formations: DataFrame, ranking: RankingSpec, rule: UniverseRule) -> DataFrame:
    """The universe at the formation dates, written once for all variants of an audit."""
    trailing = bool({"mom_12_1", "vol_12m"} & set(required_columns(ranking.names)))
    return materialize(select_universe(cross_sections(returns, formations, trailing), rule))


def fundamentals_for(sections: DataFrame, fundamentals: DataFrame, formations: DataFrame, ranking: RankingSpec,
                     asof_col: str = PUBLIC) -> DataFrame:
    need = set(required_columns(ranking.names))
    return attach_fundamentals(sections, fundamentals, formations, asof_col,
                               values=[c for c in FUNDAMENTAL_VALUES if c in need], prior=bool(need & set(PRIOR.values())))


def lookahead_audit(returns: DataFrame, fundamentals: DataFrame, formations: DataFrame, ranking: RankingSpec,
                    forward: DataFrame, rule: UniverseRule = UniverseRule()) -> DataFrame:
    """Ranking on the period end instead of the publication date: one universe, two lookups, one ranking."""
    sections = sections_for(returns, formations, ranking, rule)
    right, wrong = (fundamentals_for(sections, fundamentals, formations, ranking, column).withColumn("variant", F.lit(name))
                    for name, column in (("correct", PUBLIC), ("lookahead", "fiscal_period_end")))
    return compare_spreads(compute_factors(right.unionByName(wrong), ranking.names), ranking, forward, rule)


def momentum_audit(returns: DataFrame, formations: DataFrame, forward: DataFrame, rule: UniverseRule = UniverseRule()) -> DataFrame:
    """12-1 momentum, the same without skipping a month, and a window that reaches one month into the future.

    The three are frames of one window over the panel; each name of the universe then has a row per variant.
    """
    ranking = RankingSpec({"momentum_12_1": 1.0})
    frames = {"skip_month": (1, 0), "no_skip": (0, 0), "future_month": (0, 1)}
    rows = returns
    for name, (skip, shift) in frames.items():
        rows = with_trailing(rows, skip=skip, shift=shift, momentum=f"_{name}", volatility=None)
    sections = select_universe(cross_sections(rows, formations, trailing=False), rule)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_{n}").alias("mom_12_1")) for n in frames]))
    kept = [c for c in sections.columns if c not in {f"_{n}" for n in frames}]
    values = sections.withColumn("_v", each).select(*kept, "_v.*")
    return compare_spreads(compute_factors(values, ranking.names), ranking, forward, rule)


def backfilled_quarters(fundamentals: DataFrame, lag_days: int = 60) -> DataFrame:
    """Rows the back-filling mistake would invent: quarters never published, with the next quarter's values."""
    payload = [c for c in fundamentals.columns if c not in ("security_id", "fiscal_period_end", "available_date")]
    first = (fundamentals.groupBy("security_id", "fiscal_period_end")
             .agg(F.min(F.struct("available_date", *payload)).alias("_r"))
             .withColumn("_m", month_index("fiscal_period_end")))
    spans = first.groupBy("security_id").agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"))
    grid = (spans.withColumn("_m", F.explode(F.expr("sequence(lo, hi, 1)"))).where(F.col("_m") % 3 == 0)
            .select("security_id", "_m"))
    later = (Window.partitionBy("security_id").orderBy(F.desc("_m"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = grid.join(first.select("security_id", "_m", "_r"), ["security_id", "_m"], "left").withColumn(
        "_next", F.last("_r", ignorenulls=True).over(later))
    end = month_end_at("_m")
    return filled.where(F.col("_r").isNull()).select(
        "security_id", end.alias("fiscal_period_end"), F.date_add(end, lag_days).alias("available_date"),
        *[F.col(f"_next.{c}").alias(c) for c in payload])


def backfill_changes(returns: DataFrame, fundamentals: DataFrame, formations: DataFrame, forward: DataFrame,
                     rule: UniverseRule = UniverseRule()) -> DataFrame:
    """Universe rows whose newest filing changes when missing quarters are back-filled, with the leaked change."""
    at = ["formation_date", "security_id"]
    item = fundamentals.select("security_id", "fiscal_period_end", "available_date", "ebit_ttm")
    wrong = item.unionByName(backfilled_quarters(item))
    universe = select_universe(cross_sections(returns, formations, trailing=False), rule).select(*at)
    good = asof_fundamentals(item, formations, values=["ebit_ttm"])
    bad = asof_fundamentals(wrong, formations, values=["ebit_ttm"]).select(
        *at, F.col("fiscal_period_end").alias("_wrong_end"), F.col("ebit_ttm").alias("ebit_wrong"))
    floor = lambda c: at_least(c, 1.0)
    return (universe.join(good, at).join(bad, at).where(F.col("fiscal_period_end") != F.col("_wrong_end"))
            .withColumn("leak", F.log(floor("ebit_wrong") / floor("ebit_ttm")))
            .join(forward.where(F.col("fwd").isNotNull()).withColumnRenamed("date", "formation_date"), at)
            .where(F.col("leak").isNotNull()))


def backfill_audit(changes: DataFrame) -> DataFrame:
    """Forward return where the leaked number is higher against where it is lower."""
    up, down = F.when(F.col("leak") > 0, F.col("fwd")), F.when(F.col("leak") < 0, F.col("fwd"))
    return changes.agg(F.count(up).alias("n_up"), F.count(down).alias("n_down"), F.avg(up).alias("mean_up"),
                       F.avg(down).alias("mean_down"), (F.avg(up) - F.avg(down)).alias("gap"))


def last_dates(returns: DataFrame) -> DataFrame:
    return returns.groupBy("security_id").agg(F.max("date").alias("last_date"))


def survivorship_audit(returns: DataFrame, fundamentals: DataFrame, formations: DataFrame, ranking: RankingSpec,
                       forward: DataFrame, months: int = 12, rule: UniverseRule = UniverseRule()) -> DataFrame:
    """A universe that demands a year of future rows: how many names it loses, what it adds to the average return,
    and how many of its names die within the year (none, which is the sign of the mistake)."""
    sections = sections_for(returns, formations, ranking, rule)
    values = compute_factors(fundamentals_for(sections, fundamentals, formations, ranking), ranking.names)
    lasting = (values.join(last_dates(returns), "security_id")
               .where(F.col("last_date") >= F.add_months("formation_date", months)).drop("last_date"))
    deaths = returns.where("is_delisted_this_month").select("security_id", F.col("date").alias("death"))
    both = (values.withColumn("variant", F.lit("correct"))
            .unionByName(lasting.withColumn("variant", F.lit("survivors"))))
    scores = scores_of(both, ranking, rule, VARIANT)
    dies = (F.col("death") > F.col("date")) & (F.col("death") < F.add_months("date", months))
    return (scores.join(forward, ["security_id", "date"], "left").join(deaths, "security_id", "left")
            .groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean_fwd"),
                                    F.count_if(dies).alias("n_die_within_year")))


def survivor_returns(returns: DataFrame, days: int = 360) -> DataFrame:
    """Mean of monthly equal-weighted returns, for everything and for rows with a year of future."""
    rows = returns.join(last_dates(returns), "security_id")
    lives = F.datediff("last_date", "date") > days
    monthly = rows.groupBy("date").agg(F.avg("total_return").alias("a"),
                                       F.avg(F.when(lives, F.col("total_return"))).alias("s"),
                                       F.count_if(lives & F.col("is_delisted_this_month")).alias("d"))
    return monthly.agg(F.avg("a").alias("all_ew"), F.avg("s").alias("survivor_ew"), F.sum("d").alias("survivor_deaths"))


def announcement_correlation(returns: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Correlation of the clipped earnings surprise with the announcement month's return, and two months later."""
    first = fundamentals.groupBy("security_id", "fiscal_period_end").agg(
        F.min(F.struct("available_date", "ebit_ttm", "revenue_ttm")).alias("_r")).select("security_id", "fiscal_period_end", "_r.*")
    w = Window.partitionBy("security_id").orderBy("fiscal_period_end")
    surprise = safe_div(F.col("ebit_ttm") - F.lag("ebit_ttm").over(w), at_least(F.abs("revenue_ttm"), 1.0))
    s = (first.withColumn("x", at_most(at_least(surprise, -0.3), 0.3)).where(F.col("x").isNotNull())
         .withColumn("_v", F.explode(F.array(F.struct(F.lit("announcement").alias("window"), F.last_day("available_date").alias("date")),
                                             F.struct(F.lit("two_months_later").alias("window"),
                                                      F.last_day(F.add_months(F.last_day("available_date"), 2)).alias("date")))))
         .select("security_id", "x", "_v.*"))
    return (s.join(returns.select("security_id", "date", "total_return"), ["security_id", "date"])
            .groupBy("window").agg(F.corr("x", "total_return").alias("correlation"), F.count(F.lit(1)).alias("n")))


def version_counts(returns: DataFrame, fundamentals: DataFrame, dates: DataFrame, asof_col: str = "available_date") -> DataFrame:
    """The counts of ``truncation_audit`` as a plan; only with ``on_buckets`` no version is shuffled."""
    own = dates.withColumn("version", F.col("formation_date"))
    returns, fundamentals = returns.repartition("security_id"), fundamentals.repartition("security_id")
    months = F.broadcast(dates.select(F.col("formation_date").alias("version"), month_index("formation_date").alias("_v")))

    def versions(df: DataFrame, known, last) -> DataFrame:
        first = month_index(known)
        spread = df.withColumn("_v", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array())))
        return spread.join(months, "_v").where(known <= F.col("version")).drop("_v")

    date, public, period = F.col("date"), F.col("available_date"), F.col("fiscal_period_end")
    stale = month_index(F.date_add(period, MAX_STALENESS_DAYS)) + 12
    cut = build_snapshot(versions(returns, date, month_index(date) + LOOKBACK_MONTHS - 1),
                         versions(fundamentals, public, stale), own, asof_col=asof_col, keys=["version"]).drop("version")
    full = build_snapshot(returns, fundamentals, dates, asof_col=asof_col)
    at = ["formation_date", "security_id"]
    print_of = F.struct(F.xxhash64(*sorted(full.columns)), F.hash(*sorted(full.columns))).alias("_print")
    both = full.select(*at, print_of, F.lit(1).alias("_side")).unionByName(cut.select(*at, print_of, F.lit(-1).alias("_side")))
    per_row = both.groupBy(*at, "_print").agg(F.sum("_side").alias("_net"), F.count_if(F.col("_side") == 1).alias("_full"))
    return per_row.groupBy("formation_date").agg(F.sum("_full").alias("n_rows"), F.sum(F.abs("_net")).alias("n_different"))


def truncation_audit(returns: DataFrame, fundamentals: DataFrame, formations: DataFrame | None = None,
                     asof_col: str = "available_date") -> DataFrame:
    """Per formation date its snapshot rows, and how many of them change when everything after the date is removed.

    All dates run in one job (by default every month of the panel). The truncated tables are versions, one per date: a row
    belongs to the versions of dates at which it is known and can still matter, thirteen months for a return and until a
    year after it is stale for a filing, so the panel is repeated a bounded number of times. Both tables are dealt by
    security first and repeated where they lie: windows, lookups and joins are all within a security and shuffle no
    version; a security's versions stay in one task. Rows are compared by fingerprint, per security, in any order.
    ``n_different`` must be 0; another ``asof_col`` shows a leak. The result, a row per date, is written.
    """
    dates = materialize(returns.select(F.col("date").alias("formation_date")).distinct() if formations is None
                        else formations.select("formation_date").distinct())
    spark = returns.sparkSession
    with on_buckets(spark), settings(spark, BEFORE_VERSIONS):
        return materialize(version_counts(returns, fundamentals, dates, asof_col))


def quarter_gaps(fundamentals: DataFrame, days: int = 100) -> DataFrame:
    """Share of filings that follow a missing quarter, for distressed companies and others."""
    first = fundamentals.groupBy("security_id", "fiscal_period_end").agg(
        F.min(F.struct("available_date", "ebit_ttm", "book_equity")).alias("_r")).select("security_id", "fiscal_period_end", "_r.*")
    w = Window.partitionBy("security_id").orderBy("fiscal_period_end")
    gap = F.coalesce(F.datediff("fiscal_period_end", F.lag("fiscal_period_end").over(w)) > days, F.lit(False))
    distressed = F.coalesce(F.col("ebit_ttm") < 0, F.lit(False)) | F.coalesce(F.col("book_equity") < 0, F.lit(False))
    return (first.withColumn("gap_before", gap).withColumn("distressed", distressed).groupBy("distressed")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("gap_before").alias("n_gaps"),
                 F.avg(F.col("gap_before").cast("double")).alias("gap_rate")))


def restatements(fundamentals: DataFrame) -> DataFrame:
    """Share of rows whose period was published more than once, and restatements not strictly later (must be 0)."""
    per = fundamentals.groupBy("security_id", "fiscal_period_end").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("available_date").alias("d"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_restated_rows"),
                   (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("restated_share"),
                   F.sum(F.col("n") - F.col("d")).alias("n_not_later"))
