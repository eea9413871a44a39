"""The investable universe at each formation date."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import materialize
from ..schemas import MAJOR_EXCHANGES

BINS_PER_OCTAVE = 1024
SLICE_ROWS = 100_000
ONE_TASK_ROWS = 200_000


@dataclass(frozen=True)
class UniverseRule:
    """Default limits. ``max_names=None`` keeps every name that passes the filters."""
    max_names: int | None = 5000
    min_market_cap: float = 50e6
    min_price: float = 1.0
    exchanges: tuple[str, ...] = MAJOR_EXCHANGES
    exclude_sic_ranges: tuple[tuple[int, int], ...] = ((6000, 6999), (4900, 4999))

    @property
    def bounded(self) -> bool:
        """Whether a cross-section is small enough to be ordered in one task."""
        return self.max_names is not None and self.max_names <= ONE_TASK_ROWS

    def predicate(self) -> Column:
        """NaN passes no limit: Spark orders it above every number, so it is asked for by name."""
        keep = (~F.col("is_delisted_this_month")
                & (F.col("market_cap") >= self.min_market_cap) & ~F.isnan("market_cap")
                & (F.col("price") >= self.min_price) & ~F.isnan("price")
                & F.col("exchange").isin(*self.exchanges))
        for lo, hi in self.exclude_sic_ranges:
            keep = keep & ~F.col("sic_code").between(lo, hi)
        return keep


def _bin(x: Column) -> Column:
    """A whole number that never falls while the value rises: steps of a 1024th of an octave; NULL is under all."""
    top = 1100 * BINS_PER_OCTAVE
    size = F.least(F.floor(F.log2(F.abs(x)) * BINS_PER_OCTAVE), F.lit(top)) + top
    return (F.when(x.isNull(), -3 * top).when(F.isnan(x) | (x == float("inf")), 3 * top).when(x == float("-inf"), -3 * top + 1)
            .when(x > 0, size).when(x < 0, -size).otherwise(0)).cast("long")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str] = ("security_id",),
                  rank: str | None = None, by: str | None = None, descending: bool = True) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    ``by`` names the number that ``order`` starts with. Its histogram per group, in narrow bins, gives the bin in which the
    n-th row lies, and rows under it are left out before any window: a window gets little more than ``n`` rows of a group.
    Where very many rows remain (equal values, or no ``by``), they are cut to ``n`` in slices first, as many as a group's
    remaining rows fill. The histogram, a row per group and bin, is written and read back.
    """
    order, final = list(order), rank or "_position"
    rows, value = df, F.lit(0).cast("long")
    if by:
        x = F.col(by).cast("double")
        value = _bin(x if descending else F.when(F.isnan(x), float("-inf")).otherwise(-x))  # NaN is above every number
    counts = df.groupBy(*keys, value.alias("_bin")).agg(F.count(F.lit(1)).alias("_rows"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = materialize(counts.withColumn("_upto", F.sum("_rows").over(down)).where(F.col("_upto") - F.col("_rows") < n)
                       .groupBy(*keys).agg(F.min("_bin").alias("_cut"), F.max("_upto").alias("_left")))
    most = cuts.agg(F.max("_left")).first()[0] or 0
    slice_rows = max(SLICE_ROWS, 20 * n)
    if by or most > slice_rows:
        group = cuts.select(F.struct(*cuts.columns).alias("_group"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_group.{k}")) for k in keys], F.lit(True))
        rows = df.join(group, same).where(value >= F.col("_group._cut"))
        while most > slice_rows:
            slices = F.ceil(F.least(F.col("_group._left"), F.lit(most)) / slice_rows)
            inside = Window.partitionBy(*keys, F.pmod(F.xxhash64(*spread), slices)).orderBy(*order)
            rows = rows.withColumn("_slice", F.row_number().over(inside)).where(F.col("_slice") <= n).drop("_slice")
            most = -(-most // slice_rows) * n
        rows = rows.drop("_group")
    out = rows.withColumn(final, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(final) <= n)
    return out if rank else out.drop(final)


def select_universe(cross_sections: DataFrame, rule: UniverseRule = UniverseRule(), date_col: str = "formation_date",
                    keys: Sequence[str] = ()) -> DataFrame:
    """Size, price, exchange and sector filters, then the largest names by capitalisation, per formation date."""
    kept = cross_sections.where(rule.predicate())
    if rule.max_names is None:
        return kept
    return top_per_group(kept, [*keys, date_col], [F.desc("market_cap"), F.asc("security_id")], rule.max_names,
                         by="market_cap")
