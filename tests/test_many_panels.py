from dataclasses import replace
import random

from pyspark.sql import functions as F

from conftest import SF
from helpers import approx, fundamentals_df, month_ends, rows
from catalog.core import SPEC
from catalog.panel import panel
from pitrank.functions.lineage import materialize
from pitrank.operators.pit import asof_fundamentals
from pitrank.operators.universe import UniverseRule
from pitrank.plans.backtest import run_backtest
from pitrank.sources.canonical import Panel

RULE = UniverseRule(exchanges=("NYSE", "AMEX", "NASDAQ", "OTC"), exclude_sic_ranges=())


def test_two_markets_in_one_job_equal_two_runs(spark):
    spec = replace(SPEC, top_n=2, universe=RULE, factors={"momentum_12_1": 1.0, "asset_growth": 1.0})
    one = panel(spark, SF)
    two = Panel(materialize(one.returns.withColumn("total_return", -F.col("total_return") / 2)), one.fundamentals,
                one.benchmarks.withColumn("market_vw_return", F.lit(0.5)))
    both = Panel(*[materialize(a.withColumn("panel_id", F.lit(1)).unionByName(b.withColumn("panel_id", F.lit(2))))
                   for a, b in zip((one.returns, one.fundamentals, one.benchmarks), (two.returns, two.fundamentals, two.benchmarks))])
    joint = run_backtest(both, spec, panel_keys=["panel_id"])
    got = rows(joint.monthly, "panel_id", "date")
    for k, p in ((1, one), (2, two)):
        want = rows(run_backtest(p, spec).monthly, "date")
        mine = [r for r in got if r["panel_id"] == k]
        assert len(want) == len(mine) == 60
        for a, b in zip(mine, want):
            assert all(approx(a[c], b[c]) if isinstance(b[c], float) else a[c] == b[c] for c in b)
    assert joint.universe_stats.count() == 40


def test_one_security_with_most_filings(spark):
    rnd = random.Random(5)
    ends = month_ends("2015-01", 60)
    filings = {("HOT", e, e.replace(day=1).fromordinal(e.toordinal() + k)): rnd.random() for e in ends for k in range(30, 230, 4)}
    filings |= {(f"S{i}", e, e.fromordinal(e.toordinal() + 60)): rnd.random() for i in range(5) for e in ends[2::3]}
    t = ends[24:]
    got = {(r["formation_date"], r["security_id"]): r["ebit_ttm"] for r in rows(asof_fundamentals(
        fundamentals_df(spark, [(*k, v) for k, v in filings.items()]), spark.createDataFrame([(x,) for x in t], "formation_date date"),
        values=["ebit_ttm"]))}
    want = {}
    for x in t:
        for (s, e, a), v in sorted(filings.items(), key=lambda kv: kv[0][1:]):
            if a <= x and (x - e).days <= 548:
                want[(x, s)] = v
    assert got == want
