import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import approx, d, month_ends, returns_df, rows
from pitrank.operators.costs import NO_COST, CostModel
from pitrank.operators.portfolio import (combine_sleeves, holding_period_returns, shift_formations, simulate, target_weights)
from pitrank.operators.schedule import holding_months, rebalance_dates, sleeve_count
from pitrank.sources.canonical import month_ends as panel_months


def setup(spark, returns, targets, formations):
    """targets: {date: {id: weight}}"""
    cal = panel_months(returns)
    forms = spark.createDataFrame([(t,) for t in formations], "formation_date date")
    caps = returns.select("security_id", F.col("date").alias("formation_date"), "market_cap")
    rows_ = [(t, i, float(w)) for t, ws in targets.items() for i, w in ws.items()]
    t = spark.createDataFrame(rows_, "formation_date date, security_id string, weight double").join(caps, ["formation_date", "security_id"], "left")
    return t, holding_months(forms, [], cal)


def test_hand_numbers_with_a_bankruptcy(spark):
    me = month_ends("2000-01", 4)
    r = returns_df(spark, [("A", m, 0.10, 10.0, 1e8) for m in me] + [("B", m, -0.10, 10.0, 1e8) for m in me]
                   + [("C", m, x, 10.0, 1e8, None, None, None, x < -0.5) for m, x in zip(me, (0.0, 0.0, -0.8))])
    t, w = setup(spark, r, {me[0]: {"A": 0.5, "C": 0.5}}, [me[0]])
    got = rows(simulate(t, w, r, CostModel("flat", 20.0)), "date")
    assert approx(got[0]["gross"], 0.05) and approx(got[0]["net"], 0.05 - 0.002) and approx(got[0]["turnover"], 0.5)
    wa = 0.55 / 1.05
    assert approx(got[1]["gross"], wa * 0.1 + (1 - wa) * -0.8) and got[1]["turnover"] is None and got[1]["n_holdings"] == 2
    assert approx(got[2]["gross"], 0.10) and got[2]["n_holdings"] == 1      # C is gone, A carries everything


def recurrence(targets, panel, caps, months, cost):
    """Month-by-month bookkeeping with plain dictionaries: weights drift, missing names leave, targets replace."""
    w, pending, started, out = {}, 0.0, False, []
    for prev, now in zip(months, months[1:]):
        turn = None
        if prev in targets:
            new = targets[prev]
            moved = {i: abs(new.get(i, 0.0) - w.get(i, 0.0)) for i in set(new) | set(w)}
            turn = sum(moved.values()) / 2
            pending = sum(x * cost(caps.get((i, prev))) for i, x in moved.items())
            w, started = dict(new), True
        if not started:
            continue
        w = {i: x for i, x in w.items() if (i, now) in panel}
        total = sum(w.values())
        w = {i: x / total for i, x in w.items()} if total > 0 else w
        gross = sum(x * panel[(i, now)] for i, x in w.items())
        out.append((now, gross, gross - pending, turn, pending, sum(x > 0 for x in w.values())))
        pending = 0.0
        w = {i: x * (1 + panel[(i, now)]) for i, x in w.items()}
        total = sum(w.values())
        w = {i: x / total for i, x in w.items()} if total > 0 else w
    return out


def log_cost(cap):
    pts = [(math.log10(a), b) for a, b in CostModel().size_anchors]
    x = math.log10(max(cap if cap is not None else 1e7, 1e5))
    if x <= pts[0][0]:
        return pts[0][1] / 1e4
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        if x <= x1:
            return (y0 + (y1 - y0) * (x - x0) / (x1 - x0)) / 1e4
    return pts[-1][1] / 1e4


def test_closed_form_equals_the_recurrence(spark):
    rnd = random.Random(11)
    me = month_ends("2001-01", 40)
    panel, caps, data = {}, {}, []
    for s in range(25):
        dies = rnd.choice([None, None, rnd.randrange(5, 38)])
        for k, m in enumerate(me):
            if (dies is not None and k > dies) or rnd.random() < 0.02:
                continue
            x = -1.0 if dies == k and s % 2 else rnd.gauss(0.01, 0.1)
            cap = 10 ** rnd.uniform(6, 12)
            panel[(f"S{s}", m)], caps[(f"S{s}", m)] = x, cap
            data.append((f"S{s}", m, x, 10.0, 1.0, cap))
    targets = {}
    for k in (3, 6, 9, 18, 21, 30):
        names = [i for (i, m) in panel if m == me[k]]
        pick = rnd.sample(names, 6)
        raw = [rnd.random() for _ in pick]
        targets[me[k]] = {i: x / sum(raw) for i, x in zip(pick, raw)} if k != 21 else {}
    r = returns_df(spark, data)
    t, w = setup(spark, r, targets, list(targets))
    got = rows(simulate(t, w, r, CostModel()), "date")
    want = recurrence(targets, panel, caps, me, log_cost)
    assert len(got) == len(want)
    for g, (m, gross, net, turn, cost, n) in zip(got, want):
        assert g["date"] == m and g["n_holdings"] == n
        assert all(approx(g[c], x, 1e-12) for c, x in (("gross", gross), ("net", net), ("turnover", turn), ("cost", cost)))
        assert g["net"] <= g["gross"]


def test_weights(spark):
    m = spark.createDataFrame([("x", "A", 3.0), ("x", "B", 1.0)], "g string, security_id string, market_cap double")
    assert [r["weight"] for r in rows(target_weights(m, ["g"], "cap"), "security_id")] == [0.75, 0.25]
    assert [r["weight"] for r in rows(target_weights(m, ["g"]), "security_id")] == [0.5, 0.5]
    with pytest.raises(ValueError):
        target_weights(m, ["g"], "other")


def test_holding_period_returns(spark):
    me = month_ends("2000-01", 5)
    r = returns_df(spark, [("A", m, 0.1) for m in me] + [("B", me[0], 0.0), ("B", me[1], -1.0)] + [("C", me[0], 0.0)])
    t, w = setup(spark, r, {me[0]: {"A": 0.4, "B": 0.3, "C": 0.3}}, [me[0], me[3]])
    got = {x["security_id"]: x["holding_return"] for x in rows(holding_period_returns(t, w, r))}
    assert approx(got["A"], 1.1 ** 3 - 1) and approx(got["B"], -0.999) and "C" not in got


def test_schedules(spark):
    me = spark.createDataFrame([(m,) for m in month_ends("2000-01", 36)], "date date")
    assert rebalance_dates(me, "quarterly").count() == 11
    assert [r["formation_date"] for r in rows(rebalance_dates(me, "annual"), "formation_date")] == [d("2000-12-31"), d("2001-12-31")]
    assert rebalance_dates(me, "monthly").count() == 35
    sleeves = rows(rebalance_dates(me, "annual", 12, sleeves=12))
    assert len(sleeves) == 35 and {r["sleeve"] for r in sleeves} == set(range(12))
    assert all((r["formation_date"].month - 12 - r["sleeve"]) % 12 == 0 for r in sleeves)
    assert (sleeve_count("annual"), sleeve_count("quarterly"), sleeve_count("monthly")) == (12, 3, 1)
    with pytest.raises(ValueError):
        rebalance_dates(me, "weekly")
    shifted = rows(shift_formations(rebalance_dates(me, "annual"), -1), "formation_date")
    assert shifted[0]["formation_date"] == d("2000-11-30")


def test_costs(spark):
    caps = [None, 1e4, 1e7, 5e7, 2.5e8, 1e9, 1e10, 1e11, 1e13]
    df = spark.createDataFrame([(float(c) if c else None, i) for i, c in enumerate(caps)], "cap double, i int")
    got = [r[0] for r in df.orderBy("i").select(CostModel().one_way("cap")).collect()]
    assert all(approx(a, b) for a, b in zip(got, [0.015, 0.015, 0.015, 0.008, 0.004, 0.002, 0.0008, 0.0005, 0.0005]))
    mid = df.select(CostModel(multiplier=2.0).one_way(F.lit(10 ** 9.5))).first()[0]
    assert approx(mid, 2 * 14 / 1e4)
    assert df.select(NO_COST.one_way("cap")).first()[0] == 0.0
    with pytest.raises(ValueError):
        CostModel("other").one_way("cap")


def test_sleeves_average_only_the_invested(spark):
    m = spark.createDataFrame([(0, d("2000-01-31"), d("2000-02-29"), 0.1, 0.1, 0.5, 0.0, 3), (0, d("2000-01-31"), d("2000-03-31"), 0.2, 0.2, None, 0.0, 3),
                               (1, d("2000-02-29"), d("2000-03-31"), 0.4, 0.3, 0.5, 0.1, 4)],
                              "sleeve int, formation_date date, date date, gross double, net double, turnover double, cost double, n_holdings long")
    got = rows(combine_sleeves(m, 3), "date")
    assert approx(got[0]["gross"], 0.1) and approx(got[0]["turnover"], 0.5 / 3)
    assert approx(got[1]["gross"], 0.3) and approx(got[1]["cost"], 0.05) and got[1]["n_holdings"] == 7
