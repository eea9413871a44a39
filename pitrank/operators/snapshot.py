"""Everything a factor may use, one row per (formation date, security)."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import FUNDAMENTAL_VALUES, MAX_STALENESS_DAYS
from .pit import PUBLIC, asof_fundamentals
from .trailing import with_trailing

PRIOR = {"total_assets": "total_assets_prior", "shares_diluted": "shares_diluted_prior"}
CONTEXT = ["price", "market_cap", "exchange", "sic_code", "fiscal_period_end", "fundamentals_age_days"]


def cross_sections(returns: DataFrame, formations: DataFrame, trailing: bool = True,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Panel rows at the formation dates, with trailing statistics taken from the whole panel first.

    ``formations`` has one row per calendar month at most and is broadcast.
    """
    rows = with_trailing(returns, keys=keys) if trailing else returns
    shared = [k for k in keys if k in formations.columns]
    dates = formations.select(*shared, F.col("formation_date").alias("date")).distinct()
    return (rows.join(F.broadcast(dates), [*shared, "date"], "left_semi")
            .withColumn("formation_date", F.col("date")))


def attach_fundamentals(sections: DataFrame, fundamentals: DataFrame, formations: DataFrame, asof_col: str = PUBLIC,
                        max_staleness_days: int | None = MAX_STALENESS_DAYS, horizon=None,
                        values: Sequence[str] = tuple(FUNDAMENTAL_VALUES), prior: bool = True,
                        keys: Sequence[str] = ()) -> DataFrame:
    """Left-joins the newest public filing at T and, if wanted, two of its items a year earlier.

    Publication dates do not leave this function, so no factor can use them.
    """
    at = ["formation_date", *keys, "security_id"]
    common = dict(formations=formations, asof_col=asof_col, max_staleness_days=max_staleness_days, horizon=horizon,
                  keys=keys)
    now = asof_fundamentals(fundamentals, values=values, **common).drop(PUBLIC)
    out = sections.join(now, at, "left")
    if prior:
        before = asof_fundamentals(fundamentals, values=list(PRIOR), shift_months=12, **common)
        out = out.join(before.select(*at, *[F.col(c).alias(p) for c, p in PRIOR.items()]), at, "left")
    return out.withColumn("fundamentals_age_days", F.datediff("formation_date", "fiscal_period_end"))


def build_snapshot(returns: DataFrame, fundamentals: DataFrame, formations: DataFrame, asof_col: str = PUBLIC,
                   max_staleness_days: int | None = MAX_STALENESS_DAYS, horizon=None, universe=None,
                   requires: Iterable[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Snapshot for all formation dates.

    ``universe`` is an optional DataFrame -> DataFrame filter applied before any accounting data is joined: it only
    needs panel columns, and it makes the joins as small as the universe. ``requires`` names the columns the caller
    will use; parts nobody asks for are left out of the plan.
    """
    need = None if requires is None else set(requires)
    trailing = need is None or bool(need & {"mom_12_1", "vol_12m"})
    prior = need is None or bool(need & set(PRIOR.values()))
    values = [c for c in FUNDAMENTAL_VALUES if need is None or c in need]
    sections = cross_sections(returns, formations, trailing, keys)
    if universe is not None:
        sections = universe(sections)
    return attach_fundamentals(sections, fundamentals, formations, asof_col, max_staleness_days, horizon, values,
                               prior, keys)


def missing_formations(returns: DataFrame, formations: DataFrame) -> DataFrame:
    """Formation dates without a single panel row; a caller should treat any row here as an error."""
    return formations.join(returns.select(F.col("date").alias("formation_date")).distinct(), "formation_date",
                           "left_anti")
