"""Decile portfolios of the whole ranked universe."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import stats
from ..functions.lineage import materialize
from ..functions.positions import join_groups
from ..operators.portfolio import gross_only, target_weights
from ..operators.ranking import average_rank, decile_of_rank
from ..operators.schedule import STEP, holding_months
from ..plans.backtest import Scored, score
from ..plans.spec import BacktestSpec
from ..sources.canonical import Panel


def decile_assignments(rankings: DataFrame, keys: Sequence[str] = (), sleeve: int = 0) -> DataFrame:
    """Adds ``decile`` (10 = best) from the rank and the number of ranked names per formation date."""
    rows = rankings.where(F.col("sleeve") == sleeve)
    at = [*keys, "formation_date"]
    sizes = rows.groupBy(*at).agg(F.max("rank").alias("_n"))
    return join_groups(rows, sizes, at).withColumn("decile", decile_of_rank(F.col("rank"), F.col("_n"))).drop("_n")


def decile_scored(panel: Panel, spec: BacktestSpec, scored: Scored | None = None, frequency: str = "quarterly",
                  panel_keys: Sequence[str] = ()) -> Scored:
    """The strategy's own rankings when its calendar is at least as fine as ``frequency``, else a finer ranking.

    Markets are told apart by the columns that ``scored`` is keyed by, or by ``panel_keys``.
    """
    if STEP[spec.frequency] <= STEP[frequency]:
        return scored or score(panel, spec, panel_keys=panel_keys)
    from dataclasses import replace
    return score(panel, replace(spec, frequency=frequency, sleeves=False), panel_keys=scored.panel_keys if scored else panel_keys)


def decile_returns(scored: Scored, sleeve: int = 0) -> DataFrame:
    """Market keys, decile, date, gross: ten equal-weight portfolios per market without costs, all in one job."""
    keys = list(scored.panel_keys)
    book = [*keys, "decile"]
    members = decile_assignments(scored.rankings, keys, sleeve)
    targets = target_weights(members, [*book, "formation_date"])
    months = materialize(holding_months(members.select(*book, "formation_date").distinct(), book, scored.calendar))
    out = gross_only(targets, months, scored.panel.returns, book, keys)
    return out.select(*book, "date", "gross")


def decile_table(returns: DataFrame, universe_ew: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Growth and excess over the equal-weighted universe (on the decile's own months) per decile."""
    both = returns.join(universe_ew.select(*keys, "date", "universe_ew"), [*keys, "date"], "left")
    own = F.when(F.col("gross").isNotNull(), F.col("universe_ew"))
    return both.groupBy(*keys, "decile").agg(
        stats.cagr("gross").alias("cagr"), (stats.cagr("gross") - stats.cagr(own)).alias("excess"),
        stats.t_stat_excess("gross", "universe_ew").alias("t"))


def decile_summary(returns: DataFrame, table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of decile and growth, best minus worst with its t-statistic, number of upward steps.

    At most ten rows per key, so the windows are tiny."""
    group = list(keys)
    step = Window.partitionBy(*group).orderBy("decile") if group else Window.orderBy("decile")
    ranked = (table.withColumn("_rc", average_rank("cagr", group) if group else average_rank("cagr", [F.lit(1)]))
              .withColumn("_up", (F.col("cagr") > F.lag("cagr").over(step)).cast("long")))
    shape = ranked.groupBy(*group).agg(
        F.corr(F.col("decile").cast("double"), "_rc").alias("spearman"),
        F.coalesce(F.sum("_up"), F.lit(0)).alias("monotone_steps"),
        (F.max_by("decile", "cagr") == F.max("decile")).alias("top_is_best"))
    ends = (returns.groupBy(*group, "date")
            .agg(F.max(F.when(F.col("decile") == 10, F.col("gross"))).alias("top"),
                 F.max(F.when(F.col("decile") == 1, F.col("gross"))).alias("bottom"))
            .groupBy(*group).agg((stats.cagr("top") - stats.cagr("bottom")).alias("top_minus_bottom_annual"),
                                 stats.t_stat_excess("top", "bottom").alias("top_minus_bottom_t")))
    if group:
        return shape.join(ends, group)
    return shape.withColumn("_k", F.lit(1)).join(ends.withColumn("_k", F.lit(1)), "_k").drop("_k")
