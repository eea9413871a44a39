import random

import pytest
from pyspark.sql import Window, functions as F

from helpers import approx, rows
from pitrank.functions.columns import linear_quantile, piecewise_linear
from pitrank.functions.positions import ordered_positions
from pitrank.operators import factors as X
from pitrank.operators.ranking import RankingSpec, decile_of_rank, quantile_bucket, rank_stocks, select_top
from pitrank.operators.universe import UniverseRule, select_universe, top_per_group
from pitrank.plans.spec import BacktestSpec

BASE = dict(ebit_ttm=100.0, revenue_ttm=1000.0, gross_profit_ttm=400.0, net_income_ttm=60.0, operating_cash_flow_ttm=90.0,
            capex_ttm=30.0, dividends_ttm=10.0, current_assets=300.0, cash=50.0, current_liabilities=200.0, short_term_debt=20.0,
            long_term_debt=150.0, net_ppe=400.0, total_assets=900.0, book_equity=400.0, preferred_stock=0.0, minority_interest=0.0,
            shares_diluted=10.0, price=100.0, market_cap=1000.0, total_assets_prior=800.0, shares_diluted_prior=11.0, mom_12_1=0.1, vol_12m=0.2)


def snapshot(spark, **variants):
    return spark.createDataFrame([(k, *({**BASE, **v}).values()) for k, v in variants.items()],
                                 "security_id string, " + ", ".join(f"{c} double" for c in BASE))


def test_factor_values_by_hand(spark):
    s = snapshot(spark, A={}, B=dict(current_liabilities=600.0, net_ppe=500.0), C=dict(cash=None), D=dict(book_equity=-5.0, ebit_ttm=-30.0),
                 E=dict(market_cap=0.0, total_assets=0.0))
    got = {r["security_id"]: r for r in rows(X.compute_factors(s, X.list_factors()))}
    a = got["A"]
    want = dict(return_on_capital=100 / 470, earnings_yield=100 / 1120, book_to_market=0.4, earnings_to_price=0.06, sales_to_price=1.0,
                fcf_yield=0.06, shareholder_yield=0.11, gross_profitability=400 / 900, roe=0.15, accruals=-30 / 900,
                asset_growth=0.125, momentum_12_1=0.1, volatility_12m=0.2)
    assert all(approx(a[k], v) for k, v in want.items())
    assert approx(got["B"]["return_on_capital"], 0.2)          # working capital floored at zero
    assert got["C"]["return_on_capital"] is None and got["C"]["earnings_yield"] is None
    assert got["D"]["book_to_market"] is None and got["D"]["roe"] is None and got["D"]["return_on_capital"] < 0
    assert got["E"]["sales_to_price"] is None and got["E"]["gross_profitability"] is None
    cover = {r["factor"]: r for r in rows(X.factor_coverage(s))}
    assert cover["return_on_capital"]["missing_rate"] == 0.2 and cover["roe"]["n_available"] == 4


def test_registry_accepts_a_user_factor_and_rejects_bad_ones(spark):
    @X.factor("cash_share", "cash to assets", "cash / total assets", X.HIGHER, ["cash", "total_assets"])
    def cash_share():
        return F.col("cash") / F.col("total_assets")

    try:
        assert approx(rows(X.compute_factors(snapshot(spark, A={}), ["cash_share"]))[0]["cash_share"], 50 / 900)
        with pytest.raises(ValueError):
            X.factor("cash_share", "", "", X.HIGHER, [])
        with pytest.raises(ValueError):
            X.factor("other", "", "", "sideways", [])
        with pytest.raises(KeyError):
            X.compute_factors(snapshot(spark, A={}).drop("cash"), ["cash_share"])
        with pytest.raises(KeyError):
            X.get_factor("nothing")
    finally:
        X._REGISTRY.pop("cash_share")


def values(spark, data):
    return spark.createDataFrame([("2020-01-31", f"S{i:03d}", *v) for i, v in enumerate(data)],
                                 "formation_date string, security_id string, earnings_yield double, return_on_capital double")


TWO = {"earnings_yield": 0.5, "return_on_capital": 0.5}


def test_rank_sum_adds_ranks(spark):
    data = [(40.0 - i, 40.0 - ((i * 7 + 5) % 40)) for i in range(40)]
    ranked = rows(rank_stocks(values(spark, data), RankingSpec(TWO)), "rank")
    for r in ranked:
        assert r["score_raw"] == r["earnings_yield_rank"] + r["return_on_capital_rank"] and r["score"] == r["score_raw"] / 2
    assert [r["rank"] for r in ranked] == list(range(1, 41))
    assert select_top(rank_stocks(values(spark, data), RankingSpec(TWO)), 5).count() == 5


def test_missing_policies(spark):
    data = [(float(i), None if i == 4 else float(i)) for i in range(10)]
    dropped = rows(rank_stocks(values(spark, data), RankingSpec(TWO)), "rank")
    assert len(dropped) == 9 and max(r["earnings_yield_rank"] for r in dropped) == 10.0   # ranks were taken before dropping
    kept = {r["security_id"]: r for r in rows(rank_stocks(values(spark, data), RankingSpec(TWO, missing_policy="median")))}
    assert kept["S004"]["return_on_capital_rank"] == 5.0


def test_zscore_is_winsorised_and_degenerate_columns_are_zero(spark):
    rnd = random.Random(1)
    data = [(1e6 if i == 0 else rnd.gauss(0, 1), 3.0) for i in range(200)]
    got = {r["security_id"]: r for r in rows(rank_stocks(values(spark, data), RankingSpec(TWO, "zscore")))}
    assert got["S000"]["earnings_yield_z"] < 4 and all(r["return_on_capital_z"] == 0 for r in got.values())


@pytest.mark.parametrize("method,policy", [("rank_sum", "drop"), ("rank_sum", "median"), ("zscore", "drop"), ("zscore", "median")])
def test_spread_ranking_equals_the_windowed_one(spark, method, policy):
    rnd = random.Random(3)
    data = [(rnd.choice([None, 1.0, 2.0, rnd.random()]), None if rnd.random() < 0.1 else round(rnd.gauss(0, 1), 2)) for _ in range(900)]
    v = values(spark, data)
    spec = RankingSpec({"earnings_yield": 1.0, "return_on_capital": 3.0}, method, policy)
    a = {r["security_id"]: r for r in rows(rank_stocks(v, spec))}
    b = {r["security_id"]: r for r in rows(rank_stocks(v, spec, bounded=False, ranges=7))}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["rank"] == b[k]["rank"] and all(approx(a[k][c], b[k][c]) for c in ("score", "earnings_yield_rank", "return_on_capital_rank"))


def test_positions_with_one_hot_value(spark):
    xs = [5.0] * 400 + [float(i % 97) for i in range(800)]
    df = spark.createDataFrame([("g" if i % 3 else "h", x) for i, x in enumerate(xs)], "k string, x double")
    got = rows(ordered_positions(df, ["k"], ["x"], ranges=6))
    for r in got:
        group = [x for i, x in enumerate(xs) if ("g" if i % 3 else "h") == r["k"]]
        assert (r["n_before"], r["n_equal"], r["n_total"]) == (sum(x < r["x"] for x in group), group.count(r["x"]), len(group))


def test_a_value_held_by_most_rows_is_no_crowded_key(spark):
    from pitrank.functions.positions import with_positions
    df = spark.range(20_000).selectExpr("'g' AS k", "CASE WHEN id % 10 = 0 THEN CAST(id AS DOUBLE) ELSE 0.5D END AS x", "id")
    out = with_positions(df, ["k"], ["x"], ranges=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "broadcast" in plan
    n, hot = out.count(), out.where("x = 0.5").first()
    assert n == 20_000 and (hot.n_before, hot.n_equal, hot.n_total) == (1, 18_000, 20_000)
    rest = out.where("n_equal = 1").rdd.glom().map(len).collect()
    assert sum(rest) == 2000


def test_limits_choose_the_plan():
    assert UniverseRule().bounded and not UniverseRule(max_names=None).bounded
    assert not UniverseRule(max_names=50_000_000).bounded


def test_universe_filter(spark):
    data = [("A", 100e6, 5.0, "NYSE", 2000, False), ("B", 10e6, 5.0, "NYSE", 2000, False), ("C", 100e6, 0.5, "NYSE", 2000, False),
            ("D", 100e6, 5.0, "OTC", 2000, False), ("E", 100e6, 5.0, "NYSE", 6100, False), ("F", 100e6, 5.0, "AMEX", 4950, False),
            ("G", 100e6, 5.0, "NYSE", 2000, True), ("H", None, 5.0, "NYSE", 2000, False)]
    cs = spark.createDataFrame([("t", *r) for r in data], "formation_date string, security_id string, market_cap double, price double, "
                               "exchange string, sic_code long, is_delisted_this_month boolean")
    assert [r["security_id"] for r in rows(select_universe(cs))] == ["A"]
    many = spark.range(500).selectExpr("'t' AS formation_date", "CAST(id AS STRING) AS security_id", "100e6D + id % 50 AS market_cap", "5.0D AS price",
                                       "'NYSE' AS exchange", "2000L AS sic_code", "false AS is_delisted_this_month")
    top = rows(select_universe(many, UniverseRule(max_names=15)))
    assert len(top) == 15 and {r["market_cap"] for r in top} == {100e6 + 49, 100e6 + 48}
    assert top_per_group(many, ["formation_date"], [F.asc("security_id")], 3, rank="r").agg(F.max("r")).first()[0] == 3


@pytest.mark.parametrize("slice_rows", [100_000, 25])
def test_largest_names_by_a_cut_value(spark, monkeypatch, slice_rows):
    """Negative, zero, infinite, NaN, NULL and very many equal values; groups with a NULL key; slices only where many are left."""
    from pitrank.operators import universe as U
    monkeypatch.setattr(U, "SLICE_ROWS", slice_rows)
    odd = [float("inf"), float("-inf"), float("nan"), None, 0.0, -0.0, -1.5, 1e-300, -1e-300, 1e300, 2.0, 2.0]
    data = [("a", i, x) for i, x in enumerate(odd)] + [("b", i, 7.0) for i in range(400)] + [(None, i, float(i % 9)) for i in range(90)]
    df = spark.createDataFrame(data, "g string, id int, x double")
    plain = Window.partitionBy("g")
    for order, down in ((F.desc_nulls_last("x"), True), (F.asc_nulls_last("x"), False)):
        want = df.withColumn("r", F.row_number().over(plain.orderBy(order, "id"))).where("r <= 8")
        got = top_per_group(df, ["g"], [order, F.asc("id")], 8, ["id"], rank="r", by="x", descending=down)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    seen = top_per_group(df.where("g = 'b'").withColumn("x", F.col("id") + 1.0), ["g"], [F.desc("x")], 8, ["id"], by="x")
    assert seen.count() == 8 and "_group" not in seen.columns


def test_specs_reject_bad_values():
    for bad in (dict(factors={}), dict(factors={"x": 1.0}), dict(factors={"roe": -1.0}), dict(factors={"roe": 1.0}, method="x"),
                dict(factors={"roe": 1.0}, missing_policy="x")):
        with pytest.raises((ValueError, KeyError)):
            RankingSpec(**bad)
    for bad in (dict(weighting="x"), dict(frequency="weekly"), dict(top_n=0)):
        with pytest.raises(ValueError):
            BacktestSpec(**bad)
    s = BacktestSpec(top_n=7, factors={"roe": 1.0})
    assert BacktestSpec.from_dict(s.as_dict()) == s and s.key() == BacktestSpec.from_dict(s.as_dict()).key() and len(s.key()) == 12


def test_group_formulas(spark):
    df = spark.range(1, 31).select(F.col("id").alias("r"))
    dec = [x[0] for x in df.orderBy("r").select(decile_of_rank(F.col("r"), F.lit(30))).collect()]
    assert dec == [10 - (i // 3) for i in range(30)]
    q = [x[0] for x in df.orderBy("r").select(quantile_bucket(F.col("r"), F.lit(30), 3)).collect()]
    assert q == [0] * 10 + [1] * 10 + [2] * 10
    one = spark.range(1).select(linear_quantile(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 0.75).alias("q"),
                                piecewise_linear(F.lit(1.5), [(1, 10), (2, 20), (3, 0)]).alias("p")).first()
    assert one.q == 3.0 and one.p == 15.0
