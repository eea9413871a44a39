"""Rebalance calendars as Spark predicates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import month_index
from ..sources.canonical import as_date

# Months between rebalances, which is also the number of staggered sleeves.
STEP = {"annual": 12, "quarterly": 3, "monthly": 1}


def sleeve_count(frequency: str) -> int:
    return STEP[frequency]


def rebalance_dates(month_ends: DataFrame, frequency: str = "annual", anchor_month: int = 12, sleeves: int = 1,
                    offset: int = 0, start=None, end=None) -> DataFrame:
    """(sleeve, formation_date) for every sleeve; the last month end of the panel is never a formation date."""
    if frequency not in STEP:
        raise ValueError(f"frequency must be one of {sorted(STEP)}")
    last = month_ends.agg(F.max("date")).scalar()
    df = month_ends.select("date").distinct().where(F.col("date") < last)
    if start is not None:
        df = df.where(F.col("date") >= as_date(start))
    if end is not None:
        df = df.where(F.col("date") <= as_date(end))
    df = df.withColumn("sleeve", F.explode(F.sequence(F.lit(offset), F.lit(offset + sleeves - 1))))
    if STEP[frequency] > 1:
        df = df.where(F.pmod(F.month("date") - anchor_month - F.col("sleeve"), F.lit(STEP[frequency])) == 0)
    return df.select("sleeve", F.col("date").alias("formation_date"))


def holding_months(formations: DataFrame, keys: Sequence[str], calendar: DataFrame) -> DataFrame:
    """Every panel month in which a portfolio formed at ``formation_date`` is held.

    keys, formation_date, next_formation (NULL for the last one), date, nth (1 = first month after the formation). A
    window ends with the next formation of the same keys or with the panel. ``formations`` has one row per date and
    keys and ``calendar`` one row per month, so both windows here are as long as the calendar.
    """
    group = [*keys, "formation_date"]
    following = Window.partitionBy(*keys).orderBy("formation_date") if keys else Window.orderBy("formation_date")
    panel_end = calendar.agg(F.max("date")).scalar()
    spans = (formations.select(*group).withColumn("next_formation", F.lead("formation_date").over(following))
             .withColumn("_end", F.coalesce("next_formation", panel_end))
             .where(F.col("_end") > F.col("formation_date"))
             .withColumn("_m", F.explode(F.sequence(month_index("formation_date") + 1, month_index("_end")))))
    months = calendar.select("date", month_index("date").alias("_m"))
    nth = Window.partitionBy(*group).orderBy("date")
    return (spans.join(F.broadcast(months), "_m").withColumn("nth", F.row_number().over(nth))
            .select(*group, "next_formation", "date", "nth"))


def formation_dates(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The formation dates behind a table of holding months."""
    return months.where(F.col("nth") == 1).select(*keys, "formation_date")
