"""Codes and peers of factor exposures against brute force."""
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import catalog
from pitrank.llm import codes as C, exposures as E, neighbours as N, queries
from pitrank.llm.oracles import CODES

from conftest import SF
from texts import table

SCHEMA = "security_id bigint, exposures array<double>, sic_code int, code string, rank int, block int, asked int"


def securities(spark, rows):
    """rows: (id, vector) or (id, vector, sector)."""
    return spark.createDataFrame([(*r, *[None] * (3 - len(r)), "x", 1, 1, 1) for r in rows], SCHEMA)


def normal(n, width, seed=1):
    return np.random.default_rng(seed).normal(size=(n, width))


def odd_vectors(width):
    v = [float(i + 1) for i in range(width)]
    return [(1, v, 5), (1, v, 5), (2, None, 5), (3, [], 5), (4, [math.nan] + v[1:], 5), (5, [math.inf] + v[1:], 5),
            (6, [None] + v[1:], 5), (7, v[1:], 5), (8, [0.0] * width, None), (None, [-x for x in v], None), (9, v, None)]


def coded(rows, parts=16, entries=64, rounds=2):
    """Codes by comparing every part with every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    size = len(ints[0]) // parts
    cut = [[tuple(v[p * size:(p + 1) * size]) for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, s):
        return min((sum((a - b) ** 2 for a, b in zip(s, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[i]) for x in zip(*groups[i])) if i in groups else e
                        for i, e in enumerate(books[p])]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sector = {}
    for r, e in zip(rows, errors):
        sector[r[2]] = sector.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), e, sector[r[2]], digest)
                   for r, f, e in zip(rows, found, errors)), key=repr)


@pytest.mark.parametrize("spread", [1.0, 0.002, 50.0])
def test_sliced_search_is_exact(spread):
    r = np.random.default_rng(4)
    for n, width in [(64, 4), (1, 4), (3, 1), (64, 2)]:
        entries = np.floor(r.normal(size=(n, width)) * 256 * spread).astype(np.int64)
        entries[n // 2:] = entries[:n - n // 2]  # equal entries: the first wins
        points = np.floor(r.normal(size=(500, width)) * 256 * spread * 3).astype(np.int64)
        apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        entry, best = C.SlicedBook(entries).nearest(points)
        assert (entry == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_codes_equal_brute_force(spark):
    rows = [(i, [float(x) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(normal(150, 32))]
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]
    random.Random(1).shuffle(rows)
    assert table(C.exposure_codes(securities(spark, rows).repartition(3))) == coded(rows)


def test_codes_of_odd_vectors(spark):
    odd = odd_vectors(16)
    kept = [r for r in odd if r[0] in (1, 8, 9, None)]
    assert table(C.exposure_codes(securities(spark, odd))) == coded(kept)
    huge = [(20, [2.0 ** 40] + [0.0] * 15, 5)]
    assert table(C.exposure_codes(securities(spark, odd + huge))) == coded(kept)
    assert C.exposure_codes(securities(spark, [])).collect() == []
    with pytest.raises(ValueError):
        C.exposure_codes(securities(spark, [(1, [1.0] * 17)]))


def test_codes_of_factors(spark):
    """Runs on factor columns of the project's own snapshots."""
    snapshots = catalog.load().QUERIES["x01_x13_factors"](spark, SF)
    names = [n for n, t in snapshots.dtypes if t == "double"][:4]
    latest = snapshots.agg(F.max("formation_date")).first()[0]
    rows = E.packed(snapshots.where(F.col("formation_date") == latest), names).withColumn("sic_code", F.lit(1))
    whole = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names)).count()
    assert C.exposure_codes(rows, parts=2).count() == whole > 0
    peers = N.nearest_peers(rows, F.lit(True), 3)
    assert peers.groupBy("question").count().where(f"count <> {min(3, whole - 1)}").count() == 0


def test_code_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = queries.QUERIES["op12_sliced_codes"](spark, SF)
    cur = con.execute(CODES)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.select(*names)) == sorted(cur.fetchall(), key=repr)


def peers(spark, rows, asked, k):
    found = {}
    for r in N.nearest_peers(securities(spark, rows), asked, k).collect():
        found.setdefault((r["question"], r["security_id"]), []).append((r["rank"], r["peer_id"], r["product"]))
    return {q: sorted(f) for q, f in found.items()}


def exact(rows, asked_id, question, k):
    scored = [(-sum(a * b for a, b in zip(question, v)), i is None, i or 0) for i, v, *_ in rows if i != asked_id]
    return [(-s, None if none else i) for s, none, i in sorted(scored)[:k]]


def test_peers_recall_and_order(spark):
    values = normal(1200, 24) * np.random.default_rng(2).lognormal(size=(1200, 1))  # norms differ
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    found = peers(spark, rows, F.col("security_id") % 20 == 0, 20)
    hit = 0
    for (_, asked_id), got in found.items():
        want = exact(rows, asked_id, rows[asked_id][1], 20)
        assert [r for r, _, _ in got] == list(range(1, 21))
        products = [p for _, _, p in got]
        assert products == sorted(products, reverse=True)
        hit += len({i for _, i in want} & {i for _, i, _ in got})
        for _, i, p in got:
            assert p == pytest.approx(sum(a * b for a, b in zip(rows[asked_id][1], rows[i][1])), rel=1e-12)
    assert len(found) == 60 and hit >= 0.9 * 60 * 20


def test_peers_of_copies_and_few_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, v) for i in range(400)] + [(1000 + i, [float(x) for x in w]) for i, w in enumerate(normal(30, 3))]
    found = peers(spark, rows, F.col("security_id") == 0, 20)
    (got,) = found.values()
    want = exact(rows, 0, v, 20)
    assert [p for _, p, _ in got] == [i for _, i in want]
    few = peers(spark, rows[:5], F.col("security_id") == 0, 20)
    assert [p for _, p, _ in next(iter(few.values()))] == [1, 2, 3, 4]
    assert peers(spark, rows[:1], F.col("security_id") == 0, 20) == {}


def test_peers_of_odd_vectors(spark):
    odd = odd_vectors(16) + [(None, [1.0] * 16, 1), (30, [1e200] * 16, 1)]
    kept = [r for r in odd if r[0] in (1, 9) or (r[0] is None)]
    found = peers(spark, odd, F.lit(True), 20)
    assert len(found) == 3 and {i for _, i in found} == {1, 9}  # id 1 stands there twice
    for (_, asked_id), got in found.items():
        want = exact(kept, asked_id, odd[0][1], 20)
        assert [(p, i) for _, i, p in got] == want
    assert N.nearest_peers(securities(spark, []), F.lit(True)).collect() == []


def test_peer_query_over_the_given_table(spark):
    data = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = list(data.items())
    hit = total = 0
    by_query = {}
    for r in queries.QUERIES["op13_collision_neighbours"](spark, SF).collect():
        by_query.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(by_query) == {i for i in data if i % 20 == 0}
    for q, got in by_query.items():
        assert len(got) == 20
        hit += len(got & {i for _, i in exact(rows, q, data[q], 20)})
        total += 20
    assert hit >= 0.9 * total
