import datetime as dt
import random

import pytest
from helpers import approx, d, fundamentals_df, month_ends, returns_df, rows
from pitrank.audits.leakage import truncation_audit, version_counts
from pitrank.operators.pit import LookAheadWarning, asof_fundamentals
from pitrank.operators.snapshot import build_snapshot, missing_formations
from pitrank.operators.trailing import forward_returns, with_trailing
from pitrank.sources.landed import on_buckets, settings


def quarters():
    ends = [dt.date(2019, 12, 31), dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31),
            dt.date(2021, 3, 31), dt.date(2021, 6, 30), dt.date(2021, 9, 30)]
    return [(s, e, e + dt.timedelta(days=60), k + 1) for s in "AB" for k, e in enumerate(ends)]


def dates(spark, *days):
    return spark.createDataFrame([(d(x),) for x in days], "formation_date date")


def test_public_from_the_publication_date(spark):
    f = fundamentals_df(spark, quarters())
    got = rows(asof_fundamentals(f, dates(spark, "2020-11-30", "2020-10-31"), values=["ebit_ttm"]), "formation_date", "security_id")
    assert [(r["formation_date"], r["fiscal_period_end"], r["ebit_ttm"]) for r in got if r["security_id"] == "A"] == [
        (d("2020-10-31"), d("2020-06-30"), 3.0), (d("2020-11-30"), d("2020-09-30"), 4.0)]


def test_restatement_and_staleness(spark):
    extra = [("A", d("2021-03-31"), d("2021-07-15"), 99)]
    f = fundamentals_df(spark, quarters() + extra)
    got = {r["formation_date"]: r["ebit_ttm"] for r in rows(
        asof_fundamentals(f, dates(spark, "2021-06-30", "2021-07-31", "2021-08-31"), values=["ebit_ttm"])) if r["security_id"] == "A"}
    assert got == {d("2021-06-30"): 6.0, d("2021-07-31"): 99.0, d("2021-08-31"): 7.0}
    one = fundamentals_df(spark, [("A", d("2020-01-31"), d("2020-03-01"), 1)])
    # 2021-07-31 is 547 days after the period end, 2021-08-31 is 578
    got = rows(asof_fundamentals(one, dates(spark, "2021-07-31", "2021-08-31"), values=["ebit_ttm"]))
    assert [r["formation_date"] for r in got] == [d("2021-07-31")]
    got = rows(asof_fundamentals(one, dates(spark, "2021-07-31", "2021-08-31"), values=["ebit_ttm"], max_staleness_days=None, horizon="2022-12-31"))
    assert len(got) == 2
    with pytest.raises(ValueError):
        asof_fundamentals(one, max_staleness_days=None)


def test_lookahead_column_warns(spark):
    f = fundamentals_df(spark, quarters())
    with pytest.warns(LookAheadWarning):
        got = rows(asof_fundamentals(f, dates(spark, "2020-09-30"), asof_col="fiscal_period_end", values=["ebit_ttm"]), "security_id")
    assert [r["ebit_ttm"] for r in got] == [4.0, 4.0]


def brute(filings, t, back, stale):
    y, m = t.year - back // 12, t.month
    last = (dt.date(y + (m == 12), m % 12 + 1, 1) - dt.timedelta(days=1)).day
    at = dt.date(y, m, min(t.day, last))
    out = {}
    for s, e, a, v in filings:
        if a <= at and e >= at - dt.timedelta(days=stale):
            out[s] = max(out.get(s, (dt.date.min, dt.date.min, 0)), (e, a, v))
    return out


@pytest.mark.parametrize("back", [0, 12])
def test_asof_equals_brute_force(spark, back):
    rnd = random.Random(7)
    filings, seen = [], set()
    for s in range(12):
        for k in range(30):
            e = month_ends("2014-01", 120)[rnd.randrange(90)]
            a = e + dt.timedelta(days=rnd.choice([0, 29, 59, 60, 200, 540, 560, 700]))
            if (s, e, a) not in seen:
                seen.add((s, e, a))
                filings.append((f"S{s}", e, a, rnd.random()))
    ts = month_ends("2014-06", 100)
    got = {(r["formation_date"], r["security_id"]): (r["fiscal_period_end"], r["available_date"], r["ebit_ttm"]) for r in rows(
        asof_fundamentals(fundamentals_df(spark, filings), spark.createDataFrame([(t,) for t in ts], "formation_date date"),
                          values=["ebit_ttm"], shift_months=back))}
    want = {(t, s): v for t in ts for s, v in brute(filings, t, back, 548).items()}
    assert got == want and len(want) > 300


def test_trailing_statistics(spark):
    me = month_ends("2019-01", 15)
    r = returns_df(spark, [("A", m, 0.01) for m in me] + [("B", m, 0.02) for i, m in enumerate(me) if i not in (10, 11, 12)])
    got = {(x["security_id"], x["date"]): x for x in rows(with_trailing(r))}
    a = got[("A", me[13])]
    assert approx(a["mom_12_1"], 1.01 ** 11 - 1) and approx(a["vol_12m"], 0.0, 1e-6)
    assert got[("A", me[7])]["mom_12_1"] is None and got[("A", me[8])]["vol_12m"] is not None
    assert got[("A", me[8])]["mom_12_1"] is None and approx(got[("A", me[9])]["mom_12_1"], 1.01 ** 9 - 1)
    # B misses three months: 8 of the 11 momentum months are left
    assert got[("B", me[13])]["mom_12_1"] is None and got[("B", me[13])]["vol_12m"] is not None


def test_forward_returns_stop_at_death(spark):
    me = month_ends("2019-01", 4)
    got = rows(forward_returns(returns_df(spark, [("A", m, x) for m, x in zip(me, (0.1, 0.2, -1.0, 0.5))]), 2), "date")
    assert approx(got[0]["fwd"], 1.2 * 0.001 - 1) and approx(got[2]["fwd"], 0.5) and got[3]["fwd"] is None


def test_snapshot_hides_publication_dates_and_future(spark):
    me = month_ends("2019-01", 36)
    r = returns_df(spark, [(s, m, 0.01) for s in "AB" for m in me])
    f = fundamentals_df(spark, quarters())
    t = dates(spark, "2020-11-30")
    snap = build_snapshot(r, f, t)
    assert "available_date" not in snap.columns
    row = rows(snap, "security_id")[0]
    assert row["fundamentals_age_days"] == 61 and row["total_assets_prior"] is None and row["ebit_ttm"] == 4.0
    audit = truncation_audit(r, f, t).first()
    assert (audit.n_rows, audit.n_different) == (2, 0)
    every = rows(truncation_audit(r, f), "formation_date")
    assert len(every) == 36 and all((a["n_rows"], a["n_different"]) == (2, 0) for a in every)
    with pytest.warns(LookAheadWarning):
        leak = rows(truncation_audit(r, f, asof_col="fiscal_period_end"))
    assert sum(a["n_different"] for a in leak) > 0
    assert missing_formations(r, dates(spark, "2020-11-30", "2030-01-31")).count() == 1


def test_truncated_versions_are_not_shuffled(spark):
    r = returns_df(spark, [(s, m, 0.01) for s in "AB" for m in month_ends("2019-01", 36)])
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    with settings(spark, off), on_buckets(spark):
        counts = version_counts(r, fundamentals_df(spark, quarters()), dates(spark, "2020-11-30", "2021-11-30"))
        plan = counts._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    moved = [k for k in keys if "security_id" in k]  # others hold dates only
    assert moved and not any("version" in k or "formation_date" in k for k in moved)
