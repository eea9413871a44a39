import collections

import pytest
from pyspark.sql import functions as F

from pitrank.llm import shards as H

from helpers import d, returns_df
from texts import filings, odd_rows

NAMES = [f"s{i}" for i in range(7)]


def claims(names, size):
    """The same turns with each shard's whole preference order written out."""
    orders = []
    for n in names:
        at, step = H.key_number(f"offset:{n}") % size, H.key_number(f"skip:{n}") % (size - 1) + 1
        orders.append([(at + k * step) % size for k in range(size)])
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = i
    return [owner[s] for s in range(size)]


def test_table_is_filled_in_turns():
    assert H.fill_table(NAMES, 211) == claims(NAMES, 211)
    shares = collections.Counter(H.fill_table(NAMES, 907)).values()
    assert max(shares) - min(shares) <= 1
    assert H.fill_table(["one"], 2) == [0, 0]


def test_a_lost_shard_moves_little_else():
    a = [NAMES[i] for i in H.fill_table(NAMES, 907)]
    rest = [n for n in NAMES if n != "s3"]
    b = [rest[i] for i in H.fill_table(rest, 907)]
    moved = sum(x != y for x, y in zip(a, b) if x != "s3")
    assert moved < 0.2 * 907


def test_wrong_tables_are_refused():
    for names, size in (([], 7), (["a", "a"], 7), (NAMES, 5), (NAMES, 12)):
        with pytest.raises(ValueError):
            H.fill_table(names, size)


def test_return_panel_by_security(spark):
    panel = returns_df(spark, [(f"S{i % 50}", d("2020-01-31"), 0.01 * i) for i in range(500)])
    placed = H.place(panel, NAMES)
    assert placed.columns == panel.columns + ["slot", "shard"]
    table_of = H.fill_table(NAMES, H.prime_from(128 * 7))
    for r in placed.collect():
        slot = H.key_number(r["security_id"]) % len(table_of)
        assert (r["slot"], r["shard"]) == (slot, NAMES[table_of[slot]])
    assert placed.count() == 500
    plan = placed._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hash" not in plan


def test_odd_rows(spark):
    docs = filings(spark, odd_rows())
    got = H.place(docs, NAMES, key="filing_id")
    assert set(got.columns) == set(docs.columns) and got.count() == 9
    by_id = collections.defaultdict(set)
    for r in got.select("filing_id", "slot", "shard", "key").collect():
        by_id[r[0]].add(r[1:])
        assert r["key"] == "x" and r["shard"] in NAMES
    assert all(len(v) == 1 for v in by_id.values())
    assert H.place(docs.limit(0), NAMES, key="filing_id").count() == 0
    assert H.place(docs.withColumn("filing_id", F.lit(None)), NAMES, key="filing_id").select("shard").distinct().count() == 1
