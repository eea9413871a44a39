import random

import numpy as np
import xxhash

from pitrank.llm import simhash as S
from pitrank.llm.components import component_roots

from texts import filings, odd_rows, prose, table


def plain_fingerprint(text) -> int:
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: dict) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_fingerprints():
    for text in ("", " ", "One", "one two", "One TWO three", prose(500, 1), "Ünï ÄB cd é f", "a b c a b c a b c"):
        assert S.fingerprint_of(text.encode()) == plain_fingerprint(text), text


def test_near_pairs_are_all_pairs():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**64, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [
        np.array([int(b) ^ sum(1 << int(k) for k in r.choice(64, n, replace=False)) for b in base], dtype=np.uint64)
        for n in (1, 2, 3, 4)]))
    a, b = S.near_pairs(prints)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(close)) if i < j}


def test_cells_lose_no_pair():
    """Any two fingerprints within 3 bits meet in a cell."""
    import pyarrow as pa
    r = np.random.default_rng(6)
    a = r.integers(0, 2**64, 500, dtype=np.uint64)
    b = np.array([int(x) ^ sum(1 << int(k) for k in r.choice(64, 3, replace=False)) for x in a], dtype=np.uint64)

    def keys(prints):
        batch = pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], names=["fingerprint"])
        return next(S._cells(iter([batch]))).column(0).to_numpy().reshape(-1, len(prints)).T
    assert all(set(x) & set(y) for x, y in zip(keys(a), keys(b)))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(table(component_roots(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert component_roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)  # crowded cells go in several blocks
    r = random.Random(8)
    rows = []
    for k in range(12):
        words = prose(300, k).split()
        for c in range(8):
            w = list(words)
            for _ in range(c % 4):
                w[r.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, ""), (201, None), (202, "\n"), (203, "one"), (204, "ONE")]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = classes(prints)
    got = {i: (f, c) for i, f, c in table(S.near_duplicates(filings(spark, rows)))}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_odd_rows(spark):
    got = table(S.near_duplicates(filings(spark, odd_rows())))
    assert len(got) == 9 and [x for x in got if x[0] == 1] == [got[0]] * 2
    assert {x[2] for x in got if x[1] == "0" * 16} == {2}
    assert S.near_duplicates(filings(spark, [])).count() == 0
    alone = table(S.near_duplicates(filings(spark, [(None, "a"), (None, "a")])))
    assert [x[2] for x in alone] == [None, None]
