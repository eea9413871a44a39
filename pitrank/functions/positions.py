"""Exact order positions inside groups of any size.

A window ordered inside one group puts the whole group into one task. That is right for groups with a known
bound (a universe of at most ``max_names``), not for a cross-section which may hold a large part of the table.
Here the distinct values of all groups are range-partitioned together, so tasks hold equal shares of them whatever the
groups' sizes; each range is ordered on its own, and the counts of a group's earlier ranges are added. Ties are summed
before they move.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import materialize

HEAVY_SHARE = 1000


def ordered_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None,
                      weight: str | None = None) -> DataFrame:
    """One row per distinct (keys, order) with ``n_before``, ``n_equal``, ``n_total``, ascending by ``order``.

    ``n_before`` counts the rows of the group that sort strictly before, ``n_equal`` those with the same values.
    With ``weight`` a row counts that column's value instead of one. ``ranges`` is the number of range partitions, the session's number of shuffle partitions where it is not given.
    The ranges are written before they are read twice, so that both readers see the same cuts.
    """
    keys, order = list(keys), list(order)
    columns = [*keys, *order]
    dist = df.groupBy(*columns).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n_equal"))
    dealt = dist.repartitionByRange(ranges, *columns) if ranges else dist.repartitionByRange(*columns)
    ranged = materialize(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per group and range it reaches into: few more than groups and ranges together
    offsets = (ranged.groupBy(*keys, "_range").agg(F.sum("n_equal").alias("_rows"))
               .select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
                       F.sum("_rows").over(Window.partitionBy(*keys)).alias("n_total")))
    inside = (Window.partitionBy(*keys, "_range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (ranged.join(offsets, [*keys, "_range"])
            .withColumn("n_before", F.col("_offset") + F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
            .select(*columns, "n_before", "n_equal", "n_total"))


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Adds the positions to every row.

    Values that many rows share would be crowded join keys. Those with at least a thousandth of all rows are at most a
    thousand, so they are broadcast; the rows that remain have no crowded key and are joined by shuffle.
    """
    on = [*keys, *order]
    found = materialize(ordered_positions(df, keys, order, ranges))
    total = found.agg(F.sum("n_equal")).first()[0] or 0
    heavy = found.where(F.col("n_equal") * HEAVY_SHARE >= total)
    packed = F.struct("n_before", "n_equal", "n_total").alias("_p")
    tried = df.join(F.broadcast(heavy.select(*on, packed)), on, "left")
    names = [c for c in df.columns]
    crowded = tried.where(F.col("_p").isNotNull()).select(*names, "_p.*")
    rest = tried.where(F.col("_p").isNull()).select(*names).join(
        found.where(F.col("n_equal") * HEAVY_SHARE < total), on)
    return crowded.unionByName(rest.select(*names, "n_before", "n_equal", "n_total"))


def join_groups(df: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins a table of one row per group. It is written first, so Spark knows its size when it plans the join.

    Under the session's broadcast threshold the large side then stays where it is; over it there are so many groups that
    none of them is a large part, or adaptive execution splits it.
    """
    return df.join(materialize(per_group), list(keys), how)


def value_at(position, x: str = "x"):
    """Aggregate: the value standing at a zero-based order position in the output of ordered_positions."""
    return F.max(F.when((F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n_equal")), F.col(x)))


def percentiles(df: DataFrame, keys: Sequence[str], x: str, at: Sequence[float], ranges: int | None = None) -> DataFrame:
    """(keys, percentiles): interpolated percentiles of a column per group, from positions found in ranges.

    Partial maxima leave a task; no group is gathered. NULL values are to be left out before.
    """
    pos = ordered_positions(df, keys, [x], ranges)

    def one(p: float):
        h = F.lit(p) * (F.col("n_total") - 1)
        low, high, part = value_at(F.floor(h), x), value_at(F.ceil(h), x), F.max(h - F.floor(h))
        return low + (high - low) * part
    return pos.groupBy(*keys).agg(F.array(*[one(p) for p in at]).alias("percentiles"))


LOOKUP_BLOCKS = 4096


def values_at(positions: DataFrame, asked: DataFrame, x: str) -> DataFrame:
    """Adds to ``asked`` (metric, position) the value that stands there in ``positions`` of key ``metric``.

    A value covers a run of positions. Runs and asked positions meet in blocks of positions, some thousands per group, by
    equality; a value is repeated for the blocks that it reaches into.
    """
    width = F.greatest(F.ceil(F.col("n_total") / LOOKUP_BLOCKS), F.lit(1)).cast("long")
    runs = positions.where("n_equal > 0").select(
        "metric", x, F.col("n_before").alias("_from"), (F.col("n_before") + F.col("n_equal") - 1).alias("_to"), width.alias("_width"))
    runs = runs.withColumn("_block", F.explode(F.expr("sequence(_from div _width, _to div _width)")))
    one_width = positions.groupBy("metric").agg(F.max(width).alias("_w"))
    wanted = asked.join(one_width, "metric").withColumn("_block", F.expr("position div _w")).drop("_w")
    return (wanted.join(runs, ["metric", "_block"]).where(F.col("position").between(F.col("_from"), F.col("_to")))
            .drop("_block", "_from", "_to", "_width"))
