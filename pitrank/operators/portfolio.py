"""Portfolio accounting without a loop over months.

Between two formation dates renormalising multiplies all weights by one number, so the value of a holding is its
target weight times its own compounded growth while it has a row in every month, and nothing from its first missing
month on. A month's gross return is the value-weighted return of the names alive in it. All formation dates, sleeves
and portfolios ("books") are independent rows of the same job.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import log_growth
from ..functions.positions import join_groups
from .costs import CostModel


def target_weights(members: DataFrame, groups: Sequence[str], weighting: str = "equal",
                   cap: str = "market_cap") -> DataFrame:
    """Adds ``weight``: equal or by capitalisation within each group."""
    if weighting not in ("equal", "cap"):
        raise ValueError("weighting must be 'equal' or 'cap'")
    x = F.lit(1.0) if weighting == "equal" else F.col(cap)
    totals = members.groupBy(*groups).agg(F.sum(x).alias("_total"))
    return join_groups(members, totals, list(groups)).withColumn("weight", F.try_divide(x, F.col("_total"))).drop("_total")


def holding_paths(targets: DataFrame, months: DataFrame, returns: DataFrame, keys: Sequence[str] = (),
                  panel_keys: Sequence[str] = ()) -> DataFrame:
    """Month-by-month value of every holding until the next formation date.

    ``targets``: keys, formation_date, security_id, weight; ``months`` from :func:`schedule.holding_months`. Output
    adds date, total_return, market_cap, ``v_prev`` (value at the start of the month) and ``v`` (at its end).
    The months of a holding are enumerated, so the join with the panel is an equality on (month, security); it is an
    inner join, so a small book can be sent to the panel instead of moving the panel. A holding is alive as long as
    it has had a row in every month of its window so far; rows after a gap are left out.
    """
    group = [*keys, "formation_date"]
    held = targets.select(*group, "security_id", "weight").join(months, group)
    panel = (returns.where(F.col("total_return").isNotNull())
             .select(*panel_keys, "security_id", "date", "total_return", "market_cap"))
    rows = held.join(panel, [*panel_keys, "security_id", "date"])
    step = Window.partitionBy(*group, "security_id").orderBy("date")
    so_far = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("v", F.col("weight") * F.product(1 + F.col("total_return")).over(so_far))
            .withColumn("v_prev", F.coalesce(F.lag("v").over(step), F.col("weight")))
            .withColumn("_seen", F.row_number().over(step))
            .where(F.col("_seen") == F.col("nth")).drop("_seen", "nth"))


def monthly_gross(paths: DataFrame, months: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gross return and number of holdings per month; months with nothing alive have a zero return."""
    at = [*keys, "formation_date", "date"]
    sums = paths.groupBy(*at).agg(
        F.sum(F.col("v_prev") * F.col("total_return")).alias("_gain"), F.sum("v_prev").alias("_base"),
        F.count_if(F.col("v_prev") > 0).alias("_n"))
    return (months.select(*at, "nth").join(sums, at, "left")
            .select(*at, "nth",
                    F.when(F.col("_base") > 0, F.col("_gain") / F.col("_base")).otherwise(F.lit(0.0)).alias("gross"),
                    F.coalesce("_n", F.lit(0)).alias("n_holdings")))


def rebalance_trades(targets: DataFrame, paths: DataFrame, cost: CostModel = CostModel(),
                     keys: Sequence[str] = ()) -> DataFrame:
    """Turnover and cost of every rebalance: new targets against the drifted weights of the window that ends there.

    Targets and drifted weights are summed with opposite signs, which needs one shuffle and no outer join.
    ``targets`` must carry ``market_cap`` at the formation date.
    """
    group = [*keys, "formation_date"]
    at_end = paths.where(F.col("date") == F.col("next_formation"))
    totals = at_end.groupBy(*keys, "next_formation").agg(F.sum("v").alias("_total"))
    drifted = (at_end.join(totals, [*keys, "next_formation"])
               .select(*keys, F.col("next_formation").alias("formation_date"), "security_id",
                       F.when(F.col("_total") > 0, -F.col("v") / F.col("_total")).otherwise(-F.col("v")).alias("_w"),
                       "market_cap"))
    bought = targets.select(*group, "security_id", F.col("weight").alias("_w"), "market_cap")
    delta = (bought.unionByName(drifted).groupBy(*group, "security_id")
             .agg(F.abs(F.sum("_w")).alias("_d"), F.max("market_cap").alias("_cap")))
    return delta.groupBy(*group).agg((F.sum("_d") / 2).alias("turnover"),
                                     F.sum(F.col("_d") * cost.one_way("_cap")).alias("cost"))


def unit_paths(members: DataFrame, months: DataFrame, returns: DataFrame, keys: Sequence[str] = (),
               panel_keys: Sequence[str] = ()) -> DataFrame:
    """Growth of one unit of every member: the one walk over the panel that any book of these members is a sum of."""
    return holding_paths(members.withColumn("weight", F.lit(1.0)), months, returns, keys, panel_keys)


def weighted_paths(units: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``holding_paths`` of targets that are members of ``units``, without another look at the panel."""
    at = [*keys, "formation_date", "security_id"]
    return (units.drop("weight").join(targets.select(*at, "weight"), at)
            .withColumns({"v": F.col("v") * F.col("weight"), "v_prev": F.col("v_prev") * F.col("weight")}))


def simulate(targets: DataFrame, months: DataFrame, returns: DataFrame, cost: CostModel = CostModel(),
             keys: Sequence[str] = (), panel_keys: Sequence[str] = (), paths: DataFrame | None = None) -> DataFrame:
    """keys, formation_date, date, gross, net, turnover, cost, n_holdings for every book in ``keys``.

    Turnover is set and the cost charged in the first month after a rebalance; the first purchase is charged too.
    ``paths`` are the targets' holding paths where they are known already.
    """
    if paths is None:
        paths = holding_paths(targets, months, returns, keys, panel_keys)
    trades = rebalance_trades(targets, paths, cost, keys)
    first = F.col("nth") == 1
    zero = F.lit(0.0)
    return (monthly_gross(paths, months, keys).join(trades, [*keys, "formation_date"], "left")
            .withColumn("turnover", F.when(first, F.coalesce("turnover", zero)))
            .withColumn("cost", F.when(first, F.coalesce("cost", zero)).otherwise(zero))
            .withColumn("net", F.col("gross") - F.col("cost"))
            .select(*keys, "formation_date", "date", "gross", "net", "turnover", "cost", "n_holdings"))


def gross_only(targets: DataFrame, months: DataFrame, returns: DataFrame, keys: Sequence[str] = (),
               panel_keys: Sequence[str] = ()) -> DataFrame:
    """Gross accounting for books whose trades are not costed (universe benchmark, decile portfolios)."""
    return monthly_gross(holding_paths(targets, months, returns, keys, panel_keys), months, keys).drop("nth")


def holding_period_returns(targets: DataFrame, months: DataFrame, returns: DataFrame, keys: Sequence[str] = (),
                           panel_keys: Sequence[str] = ()) -> DataFrame:
    """Each holding's compounded return until the next formation date, over the months it has; no row without any."""
    group = [*keys, "formation_date"]
    panel = returns.select(*panel_keys, "security_id", "date", "total_return")
    return (targets.select(*group, "security_id").join(months.select(*group, "date"), group)
            .join(panel, [*panel_keys, "security_id", "date"])
            .groupBy(*group, "security_id")
            .agg(F.expm1(F.sum(log_growth("total_return"))).alias("holding_return")))


def combine_sleeves(monthly: DataFrame, sleeves: int, keys: Sequence[str] = ()) -> DataFrame:
    """Average of the sleeves invested in a month; turnover per unit of total capital; holdings added up."""
    if sleeves == 1:
        return monthly.drop("sleeve", "formation_date")
    have = set(monthly.columns)
    parts: list[Column] = [F.avg(c).alias(c) for c in ("gross", "net", "cost", "universe_ew") if c in have]
    if "turnover" in have:
        parts.append((F.sum("turnover") / sleeves).alias("turnover"))
    if "n_holdings" in have:
        parts.append(F.sum("n_holdings").alias("n_holdings"))
    return monthly.groupBy(*keys, "date").agg(*parts)


def shift_formations(df: DataFrame, months: int) -> DataFrame:
    """Applies a portfolio formed at T as if formed ``months`` month ends later. Only the timing audit uses it."""
    return df.withColumn("formation_date", F.last_day(F.add_months("formation_date", months)))
