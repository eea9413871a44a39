import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import catalog
from conftest import SF
from pitrank.functions.lineage import materialize, shared_folder, tables_of_a_run

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["j01_asof_fundamentals", "a01_rank_sum", "p12_backtest_monthly", "v16_ttm_durations", "v20_shares_asof", "q13_momentum_audit",
          "q12_j18_survivorship_audit", "v11_u02_quarterly_plus_annual", "v18_undated_facts", "f01_universe_with_nan", "j01_asof_odd_dates",
          "p16_deciles_many_markets", "a21_testing_bar", "w04_avg_rank_unbounded_group"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    own = catalog.load()
    assert set(own.QUERIES) == set(own.ORACLES)
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "pitrank.llm", None)
    monkeypatch.delitem(sys.modules, "pitrank.llm.queries", raising=False)
    try:
        assert set(importlib.reload(entry).queries()) == set(catalog.load().QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_tables_of_a_run_are_removed(spark):
    from pathlib import Path
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    with tables_of_a_run(spark):
        kept = materialize(spark.range(5))
        assert kept.count() == 5 and set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(cur.fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == want
