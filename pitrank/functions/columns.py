"""Column-level helpers. Everything here is a JVM-side expression that stays inside code generation."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MAX_DOUBLE = 1.7976931348623157e308
RETURN_FLOOR = -0.999


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(d: Column | str) -> Column:
    """Months counted from year 0, so calendar-month arithmetic becomes integer arithmetic."""
    d = col(d)
    return F.year(d) * 12 + F.month(d)


def month_end_at(m: Column | str) -> Column:
    """Last day of the month with the given :func:`month_index`."""
    m = col(m) - 1
    return F.last_day(F.make_date(F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12)) + 1, F.lit(1)))


def month_end(d: Column | str) -> Column:
    return F.last_day(col(d))


def add_month_ends(d: Column | str, n: int) -> Column:
    return F.last_day(F.add_months(col(d), n))


def safe_div(num: Column | str, den: Column | str, positive: bool = True) -> Column:
    """``num / den``; NULL when the denominator is NULL, zero or (by default) negative."""
    num, den = col(num), col(den)
    return F.when(den > 0 if positive else den != 0, F.try_divide(num, den))


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL (Spark orders NaN above every number, so the range test drops it)."""
    x = col(x)
    return F.when(x.between(F.lit(-MAX_DOUBLE), F.lit(MAX_DOUBLE)), x)


def at_least(x: Column | str, floor: float) -> Column:
    """Lower clip which, unlike ``greatest``, leaves NULL as NULL."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(floor))))


def at_most(x: Column | str, ceiling: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(float(ceiling))))


def log_growth(r: Column | str) -> Column:
    """log(1 + r) with the return floored, so a total loss stays finite."""
    return F.log1p(at_least(r, RETURN_FLOOR))


def piecewise_linear(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation through ``points`` (ascending in x), constant outside them."""
    (x0, y0), *rest = points
    out = F.when(x <= x0, F.lit(float(y0)))
    for x1, y1 in rest:
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * F.lit((y1 - y0) / (x1 - x0)))
        x0, y0 = x1, y1
    return out.when(x.isNotNull(), F.lit(float(y0)))


def log10_points(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    return [(math.log10(a), float(b)) for a, b in points]


def linear_quantile(sorted_values: Column, p: Column | float) -> Column:
    """Linear-interpolation quantile of an ascending array with a data-dependent probability."""
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    n = F.size(sorted_values)
    h = p * (n - 1)
    lo = F.floor(h).cast("int")
    a = F.get(sorted_values, lo)
    b = F.coalesce(F.get(sorted_values, lo + 1), a)
    return F.when(n > 0, a + (b - a) * (h - lo))
