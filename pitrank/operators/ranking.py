"""Composite rankings of a cross-section: weighted rank sums or winsorised z-scores.

Groups are (keys, formation date). With ``bounded=True`` the caller states that a group has a known size limit (the
universe rule's ``max_names``), and ordered windows per group are used. Otherwise order positions are computed in
value ranges, so one very large cross-section is still spread over many tasks; the results are the same.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import safe_div
from ..functions.lineage import materialize
from ..functions.positions import join_groups, ordered_positions, value_at, with_positions
from .factors import get_factor

METHODS = ("rank_sum", "zscore")
MISSING_POLICIES = ("drop", "median")


@dataclass(frozen=True)
class RankingSpec:
    factors: Mapping[str, float]
    method: str = "rank_sum"
    missing_policy: str = "drop"
    winsor_lower: float = 0.01
    winsor_upper: float = 0.99

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.missing_policy not in MISSING_POLICIES:
            raise ValueError(f"missing_policy must be one of {MISSING_POLICIES}")
        if not self.factors:
            raise ValueError("no factor given")
        if min(self.factors.values()) <= 0:
            raise ValueError("weights must be positive")
        for name in self.factors:
            get_factor(name)

    @property
    def names(self) -> list[str]:
        return list(self.factors)

    @property
    def weights(self) -> dict[str, float]:
        total = sum(self.factors.values())
        return {f: w / total for f, w in self.factors.items()}


def _order(x: str, ascending: bool) -> Column:
    return F.asc_nulls_last(x) if ascending else F.desc_nulls_last(x)


def average_rank(x: str, groups: Sequence[str], ascending: bool = True) -> Column:
    """Rank with ties averaged: half of (rows before + 1) plus (rows up to and with the value). NULL stays NULL.

    Both counts use one ordering, so a factor costs one sort."""
    w = Window.partitionBy(*groups).orderBy(_order(x, ascending))
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) + upto) / 2)


def melt(df: DataFrame, ids: Sequence[str], ascending: Mapping[str, bool]) -> DataFrame:
    """(ids, factor, x) rows of the non-NULL values, negated where a higher value should come first."""
    signed = [F.struct(F.lit(f).alias("factor"), (F.col(f) if up else -F.col(f)).alias("x"))
              for f, up in ascending.items()]
    return (df.select(*ids, F.explode(F.array(*signed)).alias("_s")).select(*ids, "_s.*")
            .where(F.col("x").isNotNull()))


def with_average_ranks(df: DataFrame, groups: Sequence[str], ascending: Mapping[str, bool], bounded: bool = True,
                       suffix: str = "_rank", ranges: int | None = None, row_id: str = "security_id") -> DataFrame:
    """Adds ``<column><suffix>`` for every column in ``ascending``; ``row_id`` is unique within a group.

    For groups without a bound all columns are ranked in long form at once, so the number of shuffles does not depend
    on the number of columns.
    """
    if bounded:
        return df.withColumns({f + suffix: average_rank(f, groups, up) for f, up in ascending.items()})
    long = melt(df, [*groups, row_id], ascending)
    ranked = (with_positions(long, [*groups, "factor"], ["x"], ranges)
              .withColumn("_r", F.col("n_before") + (F.col("n_equal") + 1) / 2))
    wide = ranked.groupBy(*groups, row_id).agg(
        *[F.max(F.when(F.col("factor") == f, F.col("_r"))).alias(f + suffix) for f in ascending])
    return df.join(wide, [*groups, row_id], "left").select(*df.columns, *[f + suffix for f in ascending])


def with_row_rank(df: DataFrame, groups: Sequence[str], score: str, ascending: bool, tie: str = "security_id",
                  rank: str = "rank", bounded: bool = True, ranges: int | None = None) -> DataFrame:
    """Final 1..n ranking by score, ties by ``tie``."""
    if bounded:
        w = Window.partitionBy(*groups).orderBy(_order(score, ascending), F.asc(tie))
        return df.withColumn(rank, F.row_number().over(w).cast("long"))
    signed = df.withColumn("_x", F.col(score) if ascending else -F.col(score))
    pos = ordered_positions(signed, groups, ["_x", tie], ranges)
    placed = pos.select(*groups, tie, (F.col("n_before") + 1).alias(rank))
    return df.join(placed, [*groups, tie])


def winsor_bounds(df: DataFrame, groups: Sequence[str], columns: Sequence[str], lower: float, upper: float,
                  ranges: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per (groups, factor) from order positions; spread over value ranges."""
    pos = ordered_positions(melt(df, groups, dict.fromkeys(columns, True)), [*groups, "factor"], ["x"], ranges)

    def quantile(p: float) -> Column:
        h = F.lit(p) * (F.col("n_total") - 1)
        lo = value_at(F.floor(h))
        return lo + (value_at(F.ceil(h)) - lo) * F.max(h - F.floor(h))

    return pos.groupBy(*groups, "factor").agg(quantile(lower).alias("lo"), quantile(upper).alias("hi"))


def with_zscores(df: DataFrame, groups: Sequence[str], spec: RankingSpec, bounded: bool = True,
                 ranges: int | None = None) -> DataFrame:
    """Adds ``<f>_z``: clipped to the winsor bounds, standardised within the group, lower-is-better negated."""
    out = df
    if bounded:
        g = Window.partitionBy(*groups)
        out = out.withColumns({f"_{f}_{side}": F.percentile(f, F.lit(p)).over(g) for f in spec.names
                               for side, p in (("lo", spec.winsor_lower), ("hi", spec.winsor_upper))})
    else:
        bounds = winsor_bounds(df, groups, spec.names, spec.winsor_lower, spec.winsor_upper, ranges)
        wide = bounds.groupBy(*groups).agg(*[
            F.max(F.when(F.col("factor") == f, F.col(side))).alias(f"_{f}_{side}")
            for f in spec.names for side in ("lo", "hi")])
        out = join_groups(out, wide, groups, "left")
    clipped = {f"_{f}_w": F.when(F.col(f).isNotNull(), F.greatest(F.least(F.col(f), F.col(f"_{f}_hi")),
                                                                  F.col(f"_{f}_lo"))) for f in spec.names}
    out = out.withColumns(clipped)
    if bounded:
        out = out.withColumns({f"_{f}_{k}": fn(f"_{f}_w").over(g) for f in spec.names
                               for k, fn in (("mu", F.avg), ("sd", F.stddev_samp))})
    else:
        moments = out.groupBy(*groups).agg(*[fn(f"_{f}_w").alias(f"_{f}_{k}") for f in spec.names
                                             for k, fn in (("mu", F.avg), ("sd", F.stddev_samp))])
        out = join_groups(out, moments, groups, "left")
    scores = {}
    for f in spec.names:
        w, mu, sd = F.col(f"_{f}_w"), F.col(f"_{f}_mu"), F.col(f"_{f}_sd")
        z = F.when(sd > 0, F.try_divide(w - mu, sd)).otherwise(w * 0.0)
        z = z if get_factor(f).higher_is_better else -z
        scores[f + "_z"] = F.coalesce(z, F.lit(0.0)) if spec.missing_policy == "median" else z
    out = out.withColumns(scores)
    return out.drop(*[f"_{f}_{k}" for f in spec.names for k in ("lo", "hi", "w", "mu", "sd")])


def rank_stocks(values: DataFrame, spec: RankingSpec, date_col: str = "formation_date", keys: Sequence[str] = (),
                bounded: bool = True, ranges: int | None = None) -> DataFrame:
    """Adds per-factor ranks (and z-scores), ``score``, ``score_raw`` and ``rank``; drops rows the policy excludes.

    Ranks are taken before rows with a missing factor are dropped, so they may have holes.
    """
    groups = [*keys, date_col]
    names, w = spec.names, spec.weights
    if not bounded:
        values = materialize(values)
    if spec.method == "rank_sum":
        up = {f: not get_factor(f).higher_is_better for f in names}
        out = with_average_ranks(values, groups, up, bounded, ranges=ranges)
        if spec.missing_policy == "median":
            if bounded:
                g = Window.partitionBy(*groups)
                out = out.withColumns({f + "_rank": F.coalesce(F.col(f + "_rank"), (F.count(f).over(g) + 1) / 2)
                                       for f in names})
            else:
                sizes = values.groupBy(*groups).agg(*[F.count(f).alias(f"_{f}_n") for f in names])
                out = join_groups(out, sizes, groups, "left").withColumns(
                    {f + "_rank": F.coalesce(F.col(f + "_rank"), (F.col(f"_{f}_n") + 1) / 2) for f in names})
                out = out.drop(*[f"_{f}_n" for f in names])
        parts = {f: F.col(f + "_rank") for f in names}
        raw_scale, ascending = len(names), True
    else:
        out = with_zscores(values, groups, spec, bounded, ranges)
        out = out if bounded else materialize(out)
        out = with_average_ranks(out, groups, {f + "_z": False for f in names}, bounded, "_rank", ranges)
        out = out.withColumnsRenamed({f + "_z_rank": f + "_rank" for f in names})
        parts = {f: F.col(f + "_z") for f in names}
        raw_scale, ascending = 1, False
    out = out.dropna(subset=[p for f in names for p in [f + ("_rank" if spec.method == "rank_sum" else "_z")]])
    score = sum((parts[f] * F.lit(w[f]) for f in names[1:]), parts[names[0]] * F.lit(w[names[0]]))
    raw = sum((parts[f] * F.lit(w[f] * raw_scale) for f in names[1:]), parts[names[0]] * F.lit(w[names[0]] * raw_scale))
    out = out.withColumns({"score": score, "score_raw": raw})
    out = out if bounded else materialize(out)
    return with_row_rank(out, groups, "score", ascending, bounded=bounded, ranges=ranges)


def select_top(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def percent_rank_average(x: str, groups: Sequence[str]) -> Column:
    """Average rank divided by the number of values (unlike SQL percent_rank, which starts at 0)."""
    return safe_div(average_rank(x, groups), F.count(x).over(Window.partitionBy(*groups)))


def quantile_bucket(position: Column, n: Column, buckets: int) -> Column:
    """Equal-frequency bucket (0-based) of a 1-based position among n, cut at linear quantiles of the positions."""
    return F.when(n > 1, F.greatest(F.ceil((position - 1) * buckets / (n - 1)) - 1, F.lit(0))).otherwise(F.lit(0)).cast("int")


def decile_of_rank(rank: Column, n: Column, deciles: int = 10) -> Column:
    """Rank 1 (best) goes to the top decile."""
    raw = deciles - F.ceil(rank / n * deciles) + 1
    return F.greatest(F.least(raw, F.lit(deciles)), F.lit(1)).cast("int")
