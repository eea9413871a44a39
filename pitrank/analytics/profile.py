"""Descriptions of a canonical panel and of what a strategy holds."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import materialize
from ..functions.positions import join_groups, ordered_positions, percentiles as group_percentiles, value_at

QUARTER_DAYS = 91.3
# First and last industry code of each division of the standard industrial classification.
SECTORS = {"agriculture": (100, 999), "mining": (1000, 1499), "construction": (1500, 1799), "manufacturing": (2000, 3999),
           "transport_utilities": (4000, 4999), "wholesale": (5000, 5199), "retail": (5200, 5999), "finance": (6000, 6799),
           "services": (7000, 8999), "public": (9100, 9729)}


def alive_per_year(returns: DataFrame) -> DataFrame:
    """Distinct securities per calendar year and how many of them were delisted in it."""
    return returns.groupBy(F.year("date").alias("year")).agg(
        F.countDistinct("security_id").alias("n_alive"), F.count_if("is_delisted_this_month").alias("n_delisted"))


def deaths_by_year(returns: DataFrame, kinds: DataFrame) -> DataFrame:
    """Delistings per year and kind; ``kinds`` maps security_id to a label."""
    dead = returns.where("is_delisted_this_month").select("security_id", F.year("date").alias("year"))
    return dead.join(kinds, "security_id", "left").groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"))


def first_publications(fundamentals: DataFrame) -> DataFrame:
    """As first reported: the earliest publication of each fiscal period."""
    return fundamentals.groupBy("security_id", "fiscal_period_end").agg(
        F.min("available_date").alias("available_date"))


def publication_lags(fundamentals: DataFrame, percentiles: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Days from period end to publication, for first publications and for all rows.

    Lags are whole days, so counting them first leaves a few hundred rows for the exact percentiles.
    """
    def lag_counts(df: DataFrame, label: str) -> DataFrame:
        return df.select(F.datediff("available_date", "fiscal_period_end").alias("lag")).groupBy("lag").agg(
            F.count(F.lit(1)).alias("n")).withColumn("rows", F.lit(label))

    counts = lag_counts(first_publications(fundamentals), "first").unionByName(lag_counts(fundamentals, "all"))
    return counts.groupBy("rows").agg(
        F.sum("n").alias("n_rows"), F.min("lag").alias("lag_min"), F.max("lag").alias("lag_max"),
        (F.sum(F.col("lag") * F.col("n")) / F.sum("n")).alias("lag_mean"),
        F.sqrt((F.sum(F.col("lag") * F.col("lag") * F.col("n")) - F.pow(F.sum(F.col("lag") * F.col("n")), F.lit(2)) / F.sum("n"))
               / F.nullif(F.sum("n") - 1, F.lit(0))).alias("lag_std"),
        *[F.percentile("lag", F.lit(p), F.col("n")).alias(f"lag_p{int(p * 100)}") for p in percentiles])


def fundamentals_profile(fundamentals: DataFrame) -> DataFrame:
    """Missing quarters, restatements and negative values in one row."""
    per = first_publications(fundamentals).groupBy("security_id").agg(
        F.count(F.lit(1)).alias("have"),
        (F.round(F.datediff(F.max("fiscal_period_end"), F.min("fiscal_period_end")) / QUARTER_DAYS) + 1).alias("expected"))
    quarters = per.agg(F.sum("have").alias("n_first"), F.sum("expected").alias("n_expected")).withColumn("_k", F.lit(1))
    rows = fundamentals.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.coalesce((F.col("ebit_ttm") < 0).cast("double"), F.lit(0.0))).alias("negative_ebit_rate"),
        F.avg(F.coalesce((F.col("book_equity") < 0).cast("double"), F.lit(0.0))).alias("negative_equity_rate")
    ).withColumn("_k", F.lit(1))
    return rows.join(quarters, "_k").select(
        "n_rows", (1 - F.col("n_first") / F.col("n_expected")).alias("missing_quarter_rate"),
        (1 - F.col("n_first") / F.col("n_rows")).alias("restatement_rate"), "negative_ebit_rate", "negative_equity_rate")


def returns_profile(returns: DataFrame) -> DataFrame:
    """Size, delisting returns and penny-stock rate in one row."""
    dead = F.when(F.col("is_delisted_this_month"), F.col("total_return"))
    return returns.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("security_id").alias("n_securities"),
        F.count(dead).alias("n_delistings"), F.avg(dead).alias("delisting_mean"), F.stddev_samp(dead).alias("delisting_std"),
        F.min(dead).alias("delisting_min"), F.max(dead).alias("delisting_max"),
        *[F.percentile(dead, F.lit(p / 100)).alias(f"delisting_p{p}") for p in (25, 50, 75)],
        F.avg((F.col("price") < 1).cast("double")).alias("price_below_1_rate"))


def cap_percentiles(returns: DataFrame, percentiles: Sequence[float] = (0.01, 0.1, 0.5, 0.9, 0.99, 1.0),
                    ranges: int | None = None) -> DataFrame:
    """Exact capitalisation percentiles of the whole panel, taken from range-parallel order positions."""
    pos = ordered_positions(returns.where(F.col("market_cap").isNotNull())
                            .select(F.lit(1).alias("_g"), F.col("market_cap").alias("x")), ["_g"], ["x"], ranges)

    def at(p: float):
        h = F.lit(p) * (F.col("n_total") - 1)
        lo = value_at(F.floor(h))
        return lo + (value_at(F.ceil(h)) - lo) * F.max(h - F.floor(h))

    return pos.agg(*[at(p).alias(f"cap_p{int(p * 100)}") for p in percentiles])


def _with_share(counts: DataFrame) -> DataFrame:
    """Each group's part of all; there are a few groups, so one window holds them."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def exchange_shares(returns: DataFrame) -> DataFrame:
    """Share of securities per exchange, by the exchange of a security's first row."""
    first = returns.groupBy("security_id").agg(F.min_by("exchange", "date").alias("exchange"))
    counts = first.groupBy("exchange").agg(F.count(F.lit(1)).alias("n"))
    return _with_share(counts)


def sector_of(code: Column) -> Column:
    out = F.lit("other")
    for name, (first, last) in SECTORS.items():
        out = F.when(code.between(first, last), name).otherwise(out)
    return out


def sector_shares(returns: DataFrame) -> DataFrame:
    """Share of securities per sector, by the industry code of a security's first row."""
    first = returns.groupBy("security_id").agg(F.min_by("sic_code", "date").alias("_code"))
    counts = first.groupBy(sector_of(F.col("_code")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    return _with_share(counts)


def size_tilt(rankings: DataFrame, keys: Sequence[str] = ("sleeve",)) -> DataFrame:
    """Median capitalisation held against the ranked universe, and the share of picks in its smallest quarter.

    Percentiles are read off order positions found in ranges, so a cross-section may have any size.
    """
    at = [*keys, "formation_date"]
    cap, held = F.col("market_cap"), F.col("weight").isNotNull()
    known = rankings.where(cap.isNotNull()).select(*at, "market_cap", held.alias("_held"))
    every = group_percentiles(known, at, "market_cap", [0.5, 0.25]).select(
        *at, F.get("percentiles", F.lit(0)).alias("median_universe"), F.get("percentiles", F.lit(1)).alias("_q1"))
    own = group_percentiles(known.where("_held"), at, "market_cap", [0.5]).select(*at, F.get("percentiles", F.lit(0)).alias("median_held"))
    uni = materialize(every.join(own, at, "left"))
    small = (join_groups(rankings.where(held), uni, at).groupBy(*at)
             .agg(F.avg((cap < F.col("_q1")).cast("double")).alias("share_small"), F.count(F.lit(1)).alias("n_held")))
    return uni.drop("_q1").join(small, at)
