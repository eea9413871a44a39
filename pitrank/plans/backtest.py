"""Composition of the operators into one lazily planned backtest."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import materialize
from ..operators.factors import compute_factors, required_columns
from ..operators.pit import PUBLIC
from ..operators.portfolio import (combine_sleeves, gross_only, holding_period_returns, monthly_gross,
                                   shift_formations, simulate, target_weights, unit_paths, weighted_paths)
from ..operators.ranking import rank_stocks, select_top
from ..operators.schedule import formation_dates, holding_months, rebalance_dates
from ..operators.snapshot import CONTEXT, build_snapshot
from ..operators.universe import select_universe, top_per_group
from ..sources.canonical import Panel, month_ends, prepare_panel
from .spec import BacktestSpec

KEY = ["sleeve"]


@dataclass
class Scored:
    """Stage one of a backtest: calendars, universes and rankings of all sleeves."""
    panel: Panel
    calendar: DataFrame
    months: DataFrame
    formations: DataFrame
    universe: DataFrame
    rankings: DataFrame
    alive: DataFrame
    panel_keys: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return [*self.panel_keys, *KEY]


class BacktestResult:
    """The tables of one run; each is planned when it is first asked for."""

    def __init__(self, spec: BacktestSpec, scored: Scored):
        self.spec, self.scored = spec, scored

    @cached_property
    def targets(self) -> DataFrame:
        top = select_top(self.scored.rankings, self.spec.top_n)
        return target_weights(top, ["formation_date", *self.scored.keys], self.spec.weighting)

    @cached_property
    def monthly(self) -> DataFrame:
        return backtest_monthly(self.scored, self.targets, self.spec)

    @cached_property
    def rankings(self) -> DataFrame:
        """Every ranked name with its weight and its return until the next formation date, where it is held."""
        s = self.scored
        at = ["formation_date", *s.keys, "security_id"]
        held = holding_period_returns(self.targets, s.months, s.panel.returns, s.keys, s.panel_keys)
        return (self.scored.rankings.join(self.targets.select(*at, "weight"), at, "left").join(held, at, "left"))

    @cached_property
    def holdings(self) -> DataFrame:
        return self.rankings.where(F.col("weight").isNotNull())

    @cached_property
    def universe_stats(self) -> DataFrame:
        return universe_funnel(self.scored)


def score(panel: Panel, spec: BacktestSpec, asof_col: str = PUBLIC, keep: bool = True,
          panel_keys: Sequence[str] = ()) -> Scored:
    """Calendar -> universe -> point-in-time snapshot -> factors -> ranking, for every sleeve and date together.

    A formation date belongs to exactly one sleeve, so snapshots carry the sleeve and are built once. ``panel_keys``
    names the columns that tell several markets with a common calendar apart; all of them run in the same jobs.
    ``keep`` writes the calendars, the universe and the rankings to the shared folder, because targets, trades, the
    universe benchmark, deciles and reports all start from them.
    """
    cut = prepare_panel(panel, spec.start, spec.end)
    save = materialize if keep else (lambda df: df)
    calendar = save(month_ends(cut.returns))
    dates = rebalance_dates(calendar, spec.frequency, spec.anchor_month, spec.n_sleeves, start=spec.start, end=spec.end)
    months = save(holding_months(dates, KEY, calendar))
    formations = formation_dates(months, KEY)
    ranking = spec.ranking
    snapshot = build_snapshot(
        cut.returns, cut.fundamentals, formations, asof_col, spec.max_staleness_days, spec.end,
        universe=lambda sections: select_universe(sections, spec.universe, keys=panel_keys),
        requires=required_columns(ranking.names), keys=panel_keys)
    universe = snapshot.join(F.broadcast(formations), "formation_date")
    keys = [*panel_keys, *KEY]
    columns = ["formation_date", *keys, "security_id", *ranking.names, *CONTEXT]
    values = save(compute_factors(universe, ranking.names).select(*dict.fromkeys(columns)))
    ranked = save(rank_stocks(values, ranking, keys=keys, bounded=spec.universe.bounded))
    members = values.select("formation_date", *keys, "security_id", "market_cap")
    alive = (cut.returns.select(*panel_keys, F.col("date").alias("formation_date"))
             .join(F.broadcast(formations), "formation_date")
             .groupBy("formation_date", *keys).agg(F.count(F.lit(1)).alias("n_alive")))
    if panel_keys:
        months = save(_per_book(months, alive.select(*panel_keys).distinct()))
        formations = formation_dates(months, keys)
    return Scored(cut, calendar, months, formations, members, ranked, alive, tuple(panel_keys))


def universe_funnel(scored: Scored) -> DataFrame:
    """Counts alive -> in the universe -> ranked, per formation date and sleeve."""
    at = ["formation_date", *scored.keys]
    uni = scored.universe.groupBy(*at).agg(F.count(F.lit(1)).alias("n_universe"))
    ranked = scored.rankings.groupBy(*at).agg(F.count(F.lit(1)).alias("n_ranked"))
    zero = F.lit(0).cast("long")
    return (scored.formations.join(scored.alive, at, "left").join(uni, at, "left").join(ranked, at, "left")
            .select(*at, *[F.coalesce(c, zero).alias(c) for c in ("n_alive", "n_universe", "n_ranked")])
            .withColumn("n_dropped_missing", F.col("n_universe") - F.col("n_ranked")))


def backtest_monthly(scored: Scored, targets: DataFrame, spec: BacktestSpec,
                     benchmarks: DataFrame | None = None) -> DataFrame:
    """Monthly result of the given targets together with the equal-weighted universe formed on the same dates."""
    keys, panel_keys = scored.keys, list(scored.panel_keys)
    uni = scored.universe
    months = scored.months
    if spec.date_shift_months:
        shift = spec.date_shift_months
        targets, uni = shift_formations(targets, shift), shift_formations(uni, shift)
        months = holding_months(shift_formations(scored.formations, shift), keys, scored.calendar)
    # one walk over the panel for all members; the book and the equal-weighted universe are sums over it
    units = materialize(unit_paths(uni, months, scored.panel.returns, keys, panel_keys))
    book = simulate(targets, months, scored.panel.returns, spec.costs, keys, panel_keys,
                    weighted_paths(units, targets, keys))
    ew = monthly_gross(units, months, keys)
    both = book.join(ew.select(*keys, "date", F.col("gross").alias("universe_ew")), [*keys, "date"], "left")
    monthly = combine_sleeves(both, spec.n_sleeves, panel_keys)
    if benchmarks is None:
        benchmarks = scored.panel.benchmarks
    shared = [k for k in panel_keys if k in benchmarks.columns]
    return monthly.join(benchmarks, [*shared, "date"], "left")


def run_backtest(panel: Panel, spec: BacktestSpec, asof_col: str = PUBLIC, keep: bool = True, check: bool = True,
                 panel_keys: Sequence[str] = ()) -> BacktestResult:
    """Plans the whole backtest. ``check`` counts calendar rows first and rejects windows that cannot be used."""
    s = score(panel, spec, asof_col, keep, panel_keys)
    if check:
        require_usable_window(s, spec)
    return BacktestResult(spec, s)


def require_usable_window(scored: Scored, spec: BacktestSpec) -> None:
    months = scored.calendar.where(F.col("date") >= F.lit(spec.start).cast("date")).count()
    if months < 13:
        raise ValueError(f"{spec.start}..{spec.end} holds {months} months; at least 13 are needed")
    if scored.formations.where(F.col("sleeve") == 0).isEmpty():
        raise ValueError(f"no {spec.frequency} rebalance date in {spec.start}..{spec.end}")
    if scored.panel_keys:
        own = (scored.panel.returns.groupBy(*scored.panel_keys)
               .agg(F.count_distinct("date").alias("n")).agg(F.min("n"), F.max("n")).first())
        if own[0] != own[1]:
            raise ValueError(f"markets need a common calendar; one has {own[0]} months, another {own[1]}")
    bare = scored.formations.join(scored.alive, ["formation_date", *scored.keys], "left_anti")
    if not bare.isEmpty():
        raise ValueError("a formation date has no panel rows")


def holdings_at(result: BacktestResult, formation_date: str, sleeve: int = 0) -> DataFrame:
    return (result.holdings.where((F.col("formation_date") == F.lit(formation_date).cast("date"))
                                  & (F.col("sleeve") == sleeve)).orderBy("rank"))


def top_of_ranking(result: BacktestResult, formation_date: str, sleeve: int = 0, n: int = 300) -> DataFrame:
    return (result.rankings.where((F.col("formation_date") == F.lit(formation_date).cast("date"))
                                  & (F.col("sleeve") == sleeve)).orderBy("rank").limit(n))


def run_scores(panel: Panel, scores: DataFrame | Callable[[DataFrame], DataFrame], spec: BacktestSpec,
               higher_is_better: bool = True, keys: Sequence[str] = (), lookback: bool = False,
               panel_keys: Sequence[str] = ()) -> DataFrame:
    """Top-N backtest on any supplied score table (``keys``, security_id, date, score); all keys in one job.

    ``panel_keys`` names the columns that tell several markets with a common calendar apart. The panel and the scores
    carry them, universes are formed per market, and they come first in the result.

    One sleeve and no lookback by default: the supplied score is the signal, nothing has to be computed from it.
    A table is cut to the formation dates before it is shuffled. ``scores`` may also be a function that scores the
    universe's rows (security_id, date, market_cap) and keeps them, so that nothing is made for other rows.
    """
    cut = prepare_panel(panel, spec.start, spec.end)
    returns = cut.returns if lookback else cut.returns.where(F.col("date") >= F.lit(spec.start).cast("date"))
    calendar = materialize(month_ends(returns))
    plain = materialize(holding_months(rebalance_dates(calendar, spec.frequency, spec.anchor_month), [], calendar))
    formations = formation_dates(plain, [])
    sections = (returns.join(F.broadcast(formations.withColumnRenamed("formation_date", "date")), "date", "left_semi")
                .withColumn("formation_date", F.col("date")))
    panel_keys = list(panel_keys)
    keys = [*panel_keys, *[k for k in keys if k not in panel_keys]]
    universe = materialize(select_universe(sections, spec.universe, keys=panel_keys)
                           .select(*panel_keys, "formation_date", "security_id", "market_cap"))
    if isinstance(scores, DataFrame):
        given = (scores.where(F.col("score").isNotNull())
                 .select(*keys, F.col("date").alias("formation_date"), "security_id", "score")
                 .join(F.broadcast(formations.select("formation_date")), "formation_date", "left_semi"))
        scored = given.join(universe, [*panel_keys, "formation_date", "security_id"])
    else:
        scored = (scores(universe.withColumnRenamed("formation_date", "date"))
                  .where(F.col("score").isNotNull()).withColumnRenamed("date", "formation_date"))
    best = F.desc("score") if higher_is_better else F.asc("score")
    chosen = top_per_group(scored, [*keys, "formation_date"], [best, F.asc("security_id")], spec.top_n, by="score",
                           descending=higher_is_better)
    targets = materialize(target_weights(chosen, [*keys, "formation_date"], spec.weighting))
    months = _per_book(plain, targets.select(*keys).distinct()) if keys else plain
    book = simulate(targets, months, returns, spec.costs, keys, panel_keys)
    markets = _per_book(plain, universe.select(*panel_keys).distinct()) if panel_keys else plain
    ew = gross_only(target_weights(universe, [*panel_keys, "formation_date"]), markets, returns, panel_keys, panel_keys)
    return (book.drop("formation_date")
            .join(ew.select(*panel_keys, "date", F.col("gross").alias("universe_ew")), [*panel_keys, "date"], "left"))


def _per_book(months: DataFrame, books: DataFrame) -> DataFrame:
    """The same calendar for every book: the calendar, a few hundred rows at most, travels as one array."""
    packed = months.agg(F.collect_list(F.struct(*months.columns))).scalar()
    return books.withColumn("_w", F.explode(packed)).select(*books.columns, "_w.*")
