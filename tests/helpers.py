"""Small builders of canonical tables for hand-worked tests."""
from __future__ import annotations

import datetime as dt

from pitrank.schemas import FUNDAMENTAL_VALUES, FUNDAMENTALS, RETURNS


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def month_ends(start: str, n: int) -> list[dt.date]:
    y, m = int(start[:4]), int(start[5:7])
    out = []
    for _ in range(n):
        y2, m2 = (y, m + 1) if m < 12 else (y + 1, 1)
        out.append(dt.date(y2, m2, 1) - dt.timedelta(days=1))
        y, m = y2, m2
    return out


def returns_df(spark, rows):
    """rows: (id, date, return) or with further values price, shares, cap, exchange, sic, delisted."""
    full = []
    for r in rows:
        r = list(r) + [None] * (9 - len(r))
        price = r[3] if r[3] is not None else 10.0
        shares = r[4] if r[4] is not None else 1e7
        full.append((r[0], r[1], r[2], price, shares, r[5] if r[5] is not None else price * shares, r[6] or "NYSE",
                     r[7] if r[7] is not None else 2000, bool(r[8])))
    return spark.createDataFrame(full, RETURNS)


def fundamentals_df(spark, rows):
    """rows: (id, period end, available, value) -> every item equals value; or a dict of items."""
    full = []
    for i, e, a, v in rows:
        items = v if isinstance(v, dict) else {c: float(v) for c in FUNDAMENTAL_VALUES}
        full.append((i, e, a, *[items.get(c) for c in FUNDAMENTAL_VALUES]))
    return spark.createDataFrame(full, FUNDAMENTALS)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def approx(a, b, tol=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tol * max(1.0, abs(b)))
