import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from pitrank.llm import similar as S
from pitrank.llm.simhash import fingerprint_of
from pitrank.llm.words import WordHashes

from texts import filings, odd_rows, prose, table

COLUMNS = "doc_id bigint, text string, lang string, source string"


def shingles(text) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b) -> float:
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r: random.Random, base: list, n: int) -> str:
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"changed{r.randrange(10**6)}"
    return " ".join(w)


def families(seed: int) -> list:
    r, rows = random.Random(seed), []
    for k in range(25):
        base = [f"{w}{r.randrange(40)}" for w in prose(r.choice([60, 200, 400]), k).split()]
        rows += [(len(rows) + c, edited(r, base, n)) for c, n in enumerate((0, 1, 2, 5, 9, 20))]
    return rows


def groups(rows) -> dict:
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if j < i and root[i] != root[j] and jaccard(a, b) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


def test_stage_on_edited_copies_against_exact_jaccard(spark):
    rows = families(5)
    want = groups(rows)
    assert len(rows) > len(set(want.values())) > 25
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], COLUMNS)
    got = [r[0] for r in table(C.drop_near_duplicates(spark, docs, ""))]
    assert sorted(got) == sorted(set(want.values()))


@pytest.mark.parametrize("chunk", [2_000_000, 1200])
def test_groups_and_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK_SHINGLES", chunk)  # some groups are compared cell by cell
    monkeypatch.setattr(S, "BLOCK", 2)  # and crowded cells in several blocks
    rows = families(6)[:60]
    want = groups(rows)
    got = {i: root for i, _, root in table(S.similar_groups(filings(spark, rows)))}
    first = {root: min(i for i in got if got[i] == root) for root in got.values()}
    assert {i: first[got[i]] for i in got} == want


def test_shingles_and_odd_rows(spark):
    for text in ("", "One", "a b c d", "a b c d e", "a b c d e f a b c d e f", prose(500, 1)):
        assert len(S.shingle_set(S.normal(text.encode()), 5, WordHashes())) == len(shingles(text))
    bodies, sets = np.arange(3), [np.arange(0, 10), np.arange(1, 10), np.arange(5, 30)]
    a, b = S.spanning_links(bodies, sets, 0.8)
    assert list(zip(a, b)) == [(0, 1)]
    got = table(S.similar_groups(filings(spark, odd_rows())))
    assert len(got) == 9 and len({g[2] for g in got if g[0] in (2, 3, 5)}) == 1
    assert S.similar_groups(filings(spark, [])).count() == 0


def test_ids_that_stand_for_several_texts(spark):
    """Rows without id and rows that share one are told by their texts."""
    rows = families(9)[:48]
    want = groups(rows)
    for ids in ([None if i % 3 else i for i, _ in rows], [7 if i % 2 else i for i, _ in rows]):
        docs = filings(spark, [(x, t) for x, (_, t) in zip(ids, rows)])
        got = {}
        for r in S.similar_groups(docs).collect():
            got[r["body"]] = r["root"]
        root = {i: got[int(np.uint64(S.body_of(S.normal(t.encode()))).astype(np.int64))] for i, t in rows}
        assert len(set(root.values())) == len(set(want.values()))
        assert all((root[i] == root[j]) == (want[i] == want[j]) for i, _ in rows for j, _ in rows)


def test_fingerprints_linked_by_pivots_are_compared(spark):
    """With one MinHash cell of so many values that only copies meet there, SimHash links still bring texts together."""
    r = random.Random(3)
    rows = []
    for k in range(12):
        base = [f"{w}{r.randrange(40)}" for w in prose(1500, k).split()]
        rows += [(len(rows) + c, edited(r, base, n)) for c, n in enumerate((0, 3))]
    prints = {i: fingerprint_of(t.encode()) for i, t in rows}
    near = {(i, i + 1) for i in range(0, 24, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 3}
    assert len(near) > 5
    docs = filings(spark, rows)
    got = {i: root for i, _, root in table(S.similar_groups(docs, S.Similar(bands=1, rows=600)))}
    assert all(got[i] == got[j] for i, j in near)
    apart = [(0, "one two three four five six"), (1, "six five four three two one")]
    assert len({root for *_, root in table(S.similar_groups(filings(spark, apart)))}) == 2


def test_shingles_are_taken_of_candidates_only(spark):
    docs = filings(spark, families(4)[:12])
    wanted = docs.select(S.mark("filing_id", "document").alias("mark"), F.lit(1).cast("long").alias("body"),
                         F.lit(1).cast("long").alias("n_rows"))
    plan = S._whole_sets(docs, wanted, S.Similar())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Join")


def test_filter_of_wanted_texts_is_as_large_as_they_need(spark, monkeypatch):
    """The driver holds the filter several times, so few texts must not cost it the largest one."""
    plans, write = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    rows = families(6)
    with S.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = table(S.similar_groups(filings(spark, rows)).select("filing_id", "root"))
    sizes = [int(bits) for plan in plans for bits in re.findall(r"bloom_filter_agg\(.*?, \d+, (\d+)", plan)]
    assert sizes and max(sizes) <= 1 << 16
    assert len({root for _, root in found}) == len(set(groups(rows).values()))
    assert [int(S.filter_for(n)[k]) for n in (0, 10 ** 6, 10 ** 9) for k in sorted(S.filter_for(n))] == [
        1, 1 << 16, 10 ** 6, 8 * 10 ** 6, 10 ** 9, 1 << 26]
