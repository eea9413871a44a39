"""Tables by year and in buckets, sinks that can be repeated, the run log, documents that cannot be read."""
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import rows
from test_contract_and_sinks import dummy
from pitrank.analytics.runlog import append_log, count_runs, log_rows, read_log, unreadable_lines
from pitrank.operators.pit import asof_fundamentals
from pitrank.operators.portfolio import holding_paths
from pitrank.operators.schedule import formation_dates, holding_months, rebalance_dates
from pitrank.operators.trailing import with_trailing
from pitrank.plans.spec import BacktestSpec
from pitrank.schemas import RETURNS
from pitrank.sources.canonical import month_ends, prepare_panel, read_panel
from pitrank.sources.landed import attach_bucketed, on_buckets, settings, write_panel_bucketed
from pitrank.sources.sinks import read_table, write_panel, write_table
from pitrank.vendor import facts as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df, table):
    """Whether a shuffle of the plan stands above the scan of a table."""
    lines = plan(df).splitlines()
    depth = [len(re.match(r"[\s:+-]*", x).group()) for x in lines]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            if any(table in x for x in lines[i + 1:below]):
                return True
    return False


def test_by_year_opens_only_the_years_within_the_bounds(spark, tmp_path):
    p = dummy(spark)
    path = write_panel(p, str(tmp_path / "panel"))
    by_year = read_panel(spark, path, by_year=True)
    cut, plain = (prepare_panel(x, "2020-06-30", "2020-12-31") for x in (by_year, p))
    for name in ("returns", "fundamentals", "benchmarks"):
        got, want = getattr(cut, name), getattr(plain, name)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ >= 2020\), \(year#\d+ <= 2020\)\]", plan(cut.benchmarks))


@pytest.fixture
def bucketed(spark, tmp_path):
    p = dummy(spark)
    yield p, write_panel_bucketed(p, str(tmp_path / "buckets"), "storage_test", 5), tmp_path
    for name in ("returns", "fundamentals"):
        spark.sql(f"DROP TABLE IF EXISTS storage_test_{name}")


def test_buckets_need_no_exchange_of_the_panel(spark, bucketed):
    p, b, tmp_path = bucketed
    calendar = month_ends(p.returns)
    months = holding_months(rebalance_dates(calendar, "quarterly", 12, 1, start="2019-03-31", end="2020-12-31"), ["sleeve"], calendar)
    dates = formation_dates(months, ["sleeve"])
    held = (p.returns.withColumnRenamed("date", "formation_date").join(F.broadcast(dates), "formation_date")
            .select("formation_date", "sleeve", "security_id", F.lit(0.1).alias("weight")))
    results = [lambda x: with_trailing(x.returns), lambda x: asof_fundamentals(x.fundamentals, dates),
               lambda x: holding_paths(held, F.broadcast(months), x.returns, ["sleeve"])]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}), on_buckets(spark):
        for make in results:
            assert sorted(map(repr, make(b).collect())) == sorted(map(repr, make(p).collect()))
        for make, name in zip(results, ("returns", "fundamentals", "returns"), strict=True):
            assert f"storage_test_{name}" in plan(make(b)) and "Bucketed: true" in plan(make(b))
            assert not shuffled(make(b), f"storage_test_{name}")
        assert shuffled(with_trailing(p.returns), "Scan")
    assert len(list((tmp_path / "buckets" / "returns").glob("*.parquet"))) <= 5


def test_a_stored_table_can_be_named_again(spark, bucketed):
    p, _, tmp_path = bucketed
    spark.sql("DROP TABLE storage_test_returns")
    again = attach_bucketed(spark, "storage_test_returns", str(tmp_path / "buckets" / "returns"), RETURNS, 5)
    assert again.count() == p.returns.count() and not shuffled(with_trailing(again), "storage_test")


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "monthly")
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "m int, net double")
    for run in ("007", "123", "007"):
        write_table(df, path, run)
    write_table(df.where("m = 1"), path, "123")
    assert [(r["run_id"], r["m"]) for r in rows(read_table(spark, path), "run_id", "m")] == [("007", 1), ("007", 2), ("123", 1)]
    assert read_table(spark, path, "123").count() == 1
    write_table(df.where("m > 9"), path, "123")  # a run without rows leaves none
    assert read_table(spark, path, "123").count() == 0 and read_table(spark, path).count() == 2
    write_table(df, str(tmp_path / "csv"), "a", "csv")
    write_table(df, str(tmp_path / "csv"), "a", "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        write_table(df, path, "a/b")


def test_log_counts_an_event_once_and_sets_broken_lines_aside(spark, tmp_path):
    path = str(tmp_path / "log")
    head = spark.createDataFrame([(0.1, "r1"), (0.2, "r2")], "cagr_net double, run_id string")
    spec = BacktestSpec(factors={"roe": 1.0})
    entries = log_rows(head, spec, "x")
    append_log(entries, path)
    append_log(entries, path)  # retried
    append_log(log_rows(head, spec, "x", event="named"), path)
    (Path(path) / "part-odd.json").write_text(
        '{"event_id": "cut", "name": "a", "config_ha\n\n{"config_hash": "h", "timestamp": 5, "cagr_net": "x"}\n{"name": "no configuration"}\n'
        '{"config_hash": "old"}\n{"config_hash": "old"}\n')
    log = read_log(spark, path)
    assert count_runs(log).first().asDict() == {"n_runs": 6, "n_trials": 2}
    assert sorted(r["cagr_net"] for r in rows(log.where("event_id IS NOT NULL"))) == [0.1, 0.1, 0.2, 0.2]
    bad = [r["line"] for r in rows(unreadable_lines(spark, path))]
    assert len(bad) == 3 and any("config_ha" in b for b in bad)


def test_documents_that_cannot_be_read_do_not_touch_others(spark, tmp_path):
    good = '{"cik": 7, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2001-03-31", "val": 5}]}}}}}'
    odd = [(1, good), (2, None), (3, "  "), (4, good[:-4]), (5, good.replace('"cik": 7', '"cik": {"a": 1}')), (6, good.replace('"cik": 7, ', "")),
           (7, good + " trailing {"), (8, "[1, 2]"), (9, good.replace("7", "8", 1)), (10, '{"cik": 9}'), (11, "nonsense")]
    docs = spark.createDataFrame(odd, "cik_row int, document string").withColumn("_d_other", F.lit(1))
    parsed, aside = X.sorted_out(docs, X.FACTS_DOCUMENT)
    problems = {r["cik_row"]: (r["problem"], r["cik"]) for r in rows(aside)}
    assert {k: v[0] for k, v in problems.items()}.items() >= {2: "empty", 3: "empty", 4: "broken", 6: "no_company", 11: "broken"}.items()
    assert problems[4][1] == 7 and problems[5][0] == "mistyped" and 1 not in problems and 9 not in problems and 10 not in problems
    assert aside.count() + parsed.count() == len(odd)
    assert sorted(r["cik"] for r in rows(X.flatten_facts(parsed)) if r["val"] == 5) == [7, 7, 8]
    assert {r["cik"]: r["n_broken"] for r in rows(X.document_counts(aside))}[7] >= 1
    (tmp_path / "docs.json").write_text(good + "\n" + good[:-3] + "\n")
    parsed, aside = X.sorted_out(X.read_documents(spark, str(tmp_path / "docs.json")), X.FACTS_DOCUMENT)
    assert parsed.count() == 1 and aside.first()["file"].endswith("docs.json")
