import json

from pyspark.sql import functions as F

from helpers import approx, d, month_ends, rows
from pitrank.sources.bars import price_bars
from pitrank.vendor import accounting as A
from pitrank.vendor import equity as E
from pitrank.vendor import facts as X
from pitrank.vendor.market import returns_from_prices, shares_asof


def test_delistings_are_compounded(spark):
    msf = spark.createDataFrame([(1, d("2020-01-31"), 0.1), (1, d("2020-02-29"), 0.1), (1, d("2020-03-31"), 0.1), (2, d("2020-01-31"), 0.05),
                                 (3, d("2020-01-31"), None), (4, d("2020-01-31"), 0.01)], "permno long, date date, ret double")
    dl = spark.createDataFrame([(1, d("2020-02-10"), -0.5, 574), (1, d("2019-02-10"), -0.9, 574), (2, d("2020-02-10"), None, 500), (3, d("2020-01-20"), None, 231),
                                (9, d("2020-01-20"), -0.4, 574)], "permno long, dlstdt date, dlret double, dlstcd int")
    got = {(r["permno"], r["date"]): r for r in rows(E.compound_delistings(msf, dl))}
    assert approx(got[(1, d("2020-02-29"))]["ret"], 1.1 * 0.5 - 1) and got[(1, d("2020-02-29"))]["is_delisted_this_month"]
    assert (1, d("2020-03-31")) not in got and not got[(1, d("2020-01-31"))]["is_delisted_this_month"]
    assert approx(got[(2, d("2020-02-29"))]["ret"], -0.3) and got[(3, d("2020-01-31"))]["ret"] == 0.0
    assert not any(k[0] == 9 for k in got) and len(got) == 6


def test_legacy_layout(spark):
    msf = spark.createDataFrame([(7, d("2020-01-30"), 0.1, -12.5, 200.0, 3, None, True), (8, d("2020-01-30"), None, 1.0, 1.0, 1, 3000, False),
                                 (9, d("2020-01-30"), 0.0, 2.0, 1.0, 8, 3000, None)],
                                "permno long, date date, ret double, prc double, shrout double, exchcd int, siccd int, is_delisted_this_month boolean")
    got = {r["security_id"]: r for r in rows(E.legacy_to_returns(msf))}
    assert set(got) == {"7", "9"} and got["7"]["price"] == 12.5 and got["7"]["market_cap"] == 12.5 * 200000 and got["7"]["exchange"] == "NASDAQ"
    assert got["7"]["sic_code"] == 0 and got["9"]["exchange"] == "OTHER" and got["9"]["is_delisted_this_month"] is False
    assert got["7"]["date"] == d("2020-01-31")


def quarter_frame(spark, data):
    return spark.createDataFrame(data, "gvkey string, fyearq int, fqtr int, oancfy double, capxy double, dvy double")


def test_year_to_date_differences(spark):
    got = rows(A.ytd_to_quarterly(quarter_frame(spark, [("a", 2020, q, v, v, None if q == 2 else v) for q, v in zip((1, 2, 3, 4), (10.0, 25.0, 45.0, 70.0))])), "fqtr")
    assert [r["oancfq"] for r in got] == [10.0, 15.0, 20.0, 25.0]
    assert [r["dvq"] for r in got] == [10.0, None, None, 25.0]           # a missing previous value gives no quarter
    got = rows(A.ytd_to_quarterly(quarter_frame(spark, [("a", 2020, q, v, v, v) for q, v in zip((1, 3, 4), (10.0, 45.0, 70.0))])), "fqtr")
    assert [r["oancfq"] for r in got] == [10.0, None, 25.0]
    assert rows(A.ytd_to_quarterly(quarter_frame(spark, [("a", 2020, 2, 9.0, 9.0, 9.0)])))[0]["oancfq"] is None


def test_trailing_sums_need_four_steady_quarters(spark):
    ends = [d(x) for x in ("2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31", "2021-03-31", "2021-06-30")]
    df = spark.createDataFrame([("a", e, float(i + 1)) for i, e in enumerate(ends)], "gvkey string, datadate date, x double")
    assert [r["t"] for r in rows(A.build_ttm(df, {"x": "t"}), "datadate")] == [None, None, None, 10.0, 14.0, 18.0]
    assert [r["t"] for r in rows(A.build_ttm(df.where(F.col("x") != 3), {"x": "t"}), "datadate")] == [None] * 5
    assert [r["t"] for r in rows(A.build_ttm(df.withColumn("x", F.when(F.col("x") != 3, F.col("x"))), {"x": "t"}), "datadate")] == [None] * 6


def test_availability_and_links(spark):
    f = spark.createDataFrame([("a", d("2020-03-31"), d("2020-05-01")), ("b", d("2020-03-31"), None), ("c", d("2020-03-31"), d("2020-03-01"))],
                              "gvkey string, datadate date, rdq date")
    got = {r["gvkey"]: r for r in rows(f.select("gvkey", A.availability_date().alias("q"), A.availability_date(annual=True).alias("y")))}
    assert (got["a"]["q"], got["b"]["q"], got["c"]["q"]) == (d("2020-05-01"), d("2020-06-29"), d("2020-06-29")) and got["a"]["y"] == d("2020-07-31")
    links = spark.createDataFrame([("a", 101, "LC", "C", d("2000-01-01"), None), ("a", 100, "LU", "P", d("2000-01-01"), None), ("a", 99, "NU", "P", d("2000-01-01"), None),
                                   ("b", 200, "LU", "P", d("2000-01-01"), d("2020-03-30")), ("b", 201, "LU", "C", d("2000-01-01"), None), ("c", 300, "LU", "J", d("2000-01-01"), None)],
                                  "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date")
    assert {(r["gvkey"], r["permno"]) for r in rows(A.resolve_links(f, links))} == {("a", 100), ("b", 201)}


def doc(facts):
    return json.dumps({"cik": 1, "facts": facts})


def entry(start, end, val, filed):
    return {"start": start, "end": end, "val": val, "filed": filed}


def flatten(spark, facts):
    return X.flatten_facts(X.parse_facts(spark.createDataFrame([(doc(facts),)], "document string")))


QUARTERS_OF = {"2019": [("03-31", 100), ("06-30", 200), ("09-30", 300)], "2020": [("03-31", 110), ("06-30", 230), ("09-30", 360)]}


def revenue():
    out = [entry("2019-01-01", "2019-12-31", 400, "2020-02-20"), entry("2020-01-01", "2020-12-31", 500, "2021-02-20"),
           entry("2019-01-01", "2019-12-31", 999, "2021-02-20")]
    for y, qs in QUARTERS_OF.items():
        out += [entry(f"{y}-01-01", f"{y}-{e}", v, f"{y}-{int(e[:2]) + 1:02d}-25") for e, v in qs]
    return out


def test_trailing_values_from_durations(spark):
    f = flatten(spark, {"us-gaap": {"Revenues": {"units": {"USD": revenue()}}}})
    got = {str(r["end"]): r for r in rows(X.ttm_from_durations(X.concept_values(f)))}
    assert {k: v["ttm"] for k, v in got.items()} == {"2019-12-31": 400, "2020-03-31": 410, "2020-06-30": 430, "2020-09-30": 460, "2020-12-31": 500}
    assert str(got["2020-06-30"]["filed"]) == "2020-07-25" and str(got["2019-12-31"]["filed"]) == "2020-02-20"     # the restated 999 is not used


def test_units_tags_and_bad_values(spark):
    f = rows(flatten(spark, {"us-gaap": {"Assets": {"units": {"EUR": [entry(None, "2020-12-31", 1, "2021-01-01")], "USD/x": [entry(None, "2020-12-31", 2, "2021-01-01")]}},
                                         "Cash": {"units": {"EUR": [entry(None, "2020-12-31", 1, "2021-01-01")]}},
                                         "GrossProfit": {"units": {"USD": [entry("2020-01-01", "2020-12-31", "n/a", "2021-01-01"), entry("bad", "2020-12-31", "7", "2021-01-01")]}}},
                             "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [entry(None, "2020-12-31", 5, "2021-01-01")]}}}}), "tag")
    assert [(r["tag"], r["val"]) for r in f] == [("Assets", 2.0), ("EntityCommonStockSharesOutstanding", 5.0), ("GrossProfit", 7.0)]
    assert f[2]["start"] is None
    both = flatten(spark, {"us-gaap": {"SalesRevenueNet": {"units": {"USD": [entry("2020-01-01", "2020-12-31", 1, "2020-12-31")]}},
                                       "Revenues": {"units": {"USD": [entry("2020-01-01", "2020-12-31", 2, "2021-03-01"), entry("2020-01-01", "2020-12-31", 3, "2022-03-01")]}}}})
    got = rows(X.concept_values(both))
    assert len(got) == 1 and got[0]["val"] == 2.0


def test_company_fundamentals(spark):
    inst = [entry(None, "2020-12-31", 1000, "2020-12-01"), entry(None, "2019-12-31", 900, "2020-03-01")]
    facts = {"us-gaap": {"Revenues": {"units": {"USD": revenue()}}, "Assets": {"units": {"USD": inst}},
                         "CostOfRevenue": {"units": {"USD": [entry("2020-01-01", "2020-12-31", 300, "2021-02-20")]}}}}
    got = {str(r["fiscal_period_end"]): r for r in rows(X.company_fundamentals(flatten(spark, facts)))}
    assert set(got) == {"2019-12-31", "2020-12-31"}
    assert got["2020-12-31"]["gross_profit_ttm"] == 200 and got["2019-12-31"]["gross_profit_ttm"] is None
    assert got["2020-12-31"]["minority_interest"] == 0 and got["2020-12-31"]["long_term_debt"] is None
    assert str(got["2019-12-31"]["available_date"]) == "2020-03-01"


def test_share_counts_as_of(spark):
    me = month_ends("2020-01", 5)
    prices = spark.createDataFrame([("A", m) for m in me] + [("B", me[0])], "security_id string, date date")
    fil = spark.createDataFrame([("A", d("2019-12-31"), 10.0, d("2020-02-10")), ("A", d("2020-01-31"), 11.0, d("2020-02-10")), ("A", d("2020-03-31"), 12.0, d("2020-04-30"))],
                                "security_id string, end date, val double, filed date")
    now = spark.createDataFrame([("A", 99.0), ("B", 77.0)], "security_id string, shares_now double")
    got = rows(shares_asof(prices, fil, now), "security_id", "date")
    assert [r["shares"] for r in got] == [11.0, 11.0, 11.0, 12.0, 12.0, 77.0]
    assert [r["shares_backfilled"] for r in got] == [True, False, False, False, False, False]


def test_returns_from_prices(spark):
    me = month_ends("2020-01", 6)
    px = [("A", m, 10.0 * 1.1 ** i, None if i == 2 else 20.0, 5.0) for i, m in enumerate(me)] + [("B", m, 10.0, 10.0, 1.0) for m in me[:3]]
    df = spark.createDataFrame(px, "security_id string, date date, adjusted double, close double, shares double").withColumn("exchange", F.lit("NYSE")).withColumn("sic_code", F.lit(1))
    got = {(r["security_id"], r["date"]): r for r in rows(returns_from_prices(df, "2020-01-31", "2020-06-30"))}
    assert approx(got[("A", me[3])]["total_return"], 1.21 - 1) and ("A", me[2]) not in got and ("A", me[0]) not in got
    assert got[("B", me[2])]["is_delisted_this_month"] and not got[("A", me[5])]["is_delisted_this_month"] and got[("A", me[1])]["market_cap"] == 100.0


def test_wide_bars(spark):
    wide = spark.createDataFrame([(d("2020-01-01"), 1.0, None), (d("2020-02-01"), 2.0, 3.0)], "date date, X double, Y double")
    got = rows(price_bars(wide, wide, ["X", "Y"]), "security_id", "date")
    assert [(r["security_id"], str(r["date"]), r["adjusted"]) for r in got] == [("X", "2020-01-31", 1.0), ("X", "2020-02-29", 2.0), ("Y", "2020-02-29", 3.0)]
