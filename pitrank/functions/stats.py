"""Performance statistics as aggregate Columns over monthly rows. NULL months are skipped throughout."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import at_most, col

MONTHS = 12


def cagr(r: Column | str) -> Column:
    """Annualised growth; -100 % when wealth is wiped out; NULL without any month."""
    r = col(r)
    n = F.count(r)
    growth = F.product(1 + r)
    return F.when(n > 0, F.when(growth > 0, F.pow(growth, F.lit(12.0) / n) - 1).otherwise(F.lit(-1.0)))


def ann_vol(r: Column | str) -> Column:
    r = col(r)
    return F.when(F.count(r) > 1, F.stddev_samp(r) * F.sqrt(F.lit(12.0)))


def sharpe(r: Column | str, rf: Column | str) -> Column:
    ex = col(r) - col(rf)
    sd = F.stddev_samp(ex)
    return F.when((F.count(ex) > 1) & (sd > 0), F.try_divide(F.avg(ex), sd) * F.sqrt(F.lit(12.0)))


def sortino(r: Column | str, rf: Column | str) -> Column:
    ex = col(r) - col(rf)
    low = at_most(ex, 0.0)
    downside = F.sqrt(F.avg(low * low))
    return F.when((F.count(ex) > 1) & (downside > 0), F.try_divide(F.avg(ex), downside) * F.sqrt(F.lit(12.0)))


def excess_cagr(r: Column | str, b: Column | str) -> Column:
    """Difference of growth rates over the months both series have."""
    r, b = col(r), col(b)
    both = r.isNotNull() & b.isNotNull()
    return cagr(F.when(both, r)) - cagr(F.when(both, b))


def t_stat_excess(r: Column | str, b: Column | str) -> Column:
    d = col(r) - col(b)
    sd = F.stddev_samp(d)
    return F.when((F.count(d) > 2) & (sd > 0), F.try_divide(F.avg(d), sd) * F.sqrt(F.count(d)))
