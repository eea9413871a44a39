import math
import random
import re
from collections import Counter, defaultdict

from pitrank.llm import lexical as L, queries

from conftest import SF
from texts import filings, odd_rows, prose, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_force(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, item in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        scores = []
        for doc_id, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(item) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def searched(spark, docs, items, k=10):
    asked = spark.createDataFrame(items, "item_id bigint, item string, score string")
    return table(L.ranked_filings(filings(spark, docs), asked, k).select("item_id", "rank", "filing_id", "score"))


def test_terms_are_those_of_the_pattern():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "Z", "é", "É", "9", " ", "_", "\x00", "\x1c", "-", "中", "😀", "\x7f"]) for _ in range(30))
        assert [t.decode() for t in L.terms_of(text.encode())] == terms(text)


def test_equals_brute_force_over_many_buckets(spark, monkeypatch):
    r = random.Random(5)
    docs = [(i, prose(r.choice([1, 5, 30, 200]), i)) for i in range(300)]
    docs += [(1000 + i, prose(40, 7)) for i in range(50)]  # copies: equal scores
    items = [(i, prose(r.choice([1, 4, 20]), 900 + i), "x") for i in range(12)] + [(99, prose(40, 7), "x")]
    want = sorted(brute_force(docs, [i[:2] for i in items]), key=repr)
    assert searched(spark, docs, items) == want
    asking = L.Asking([i[:2] for i in items])
    assert len(asking.items) == 13


def test_bounds_never_lose_a_document():
    """Survivors of any threshold hold every row that reaches it, and pruning happens."""
    r, pruned = random.Random(8), 0
    asking = L.Asking([(i, prose(6, i)) for i in range(20)])
    size = len(asking.vocabulary)
    for _ in range(30):
        rows = [sorted(r.sample(range(size), r.randint(1, size))) for _ in range(40)]
        offsets = L.np.concatenate([[0], L.np.cumsum([len(x) for x in rows])])
        found = L.np.concatenate([L.np.array(x, L.np.int64) for x in rows])
        bucket = L.Bucket(found, L.np.array([r.randint(0, 10 ** 9) for _ in found], L.np.int64), offsets, size)
        for item in asking.items:
            exact = bucket.exact(item, L.np.arange(40), size)
            for least in [1, int(exact.max()), int(sorted(exact)[-10]), int(exact.max()) + 1]:
                kept = bucket.survivors(item, max(1, least))
                assert set(L.np.flatnonzero(exact >= max(1, least))) <= set(kept)
                pruned += 40 - len(kept)
    assert pruned > 1000


def test_several_blocks_of_items(spark, monkeypatch):
    docs = [(i, prose(50, i)) for i in range(40)]
    items = [(i, prose(5, 50 + i)) for i in range(6)]
    blocks = L.item_blocks
    monkeypatch.setattr(L, "item_blocks", lambda rows: blocks(rows, 60))
    assert searched(spark, docs, [(*i, "x") for i in items], 3) == sorted(brute_force(docs, items, 3), key=repr)


def test_odd_rows(spark):
    rows = odd_rows()
    items = [(1, "Revenue GROWTH, margin"), (2, None), (3, ""), (4, "Ünïcödé 😀"), (5, "nowhere"), (1, "tax"), (None, "audit risk"),
             (7, "tax"), (7, "tax")]
    want = sorted(brute_force([r[:2] for r in rows], items), key=repr)
    assert searched(spark, rows, [(*i, "x") for i in items]) == want
    assert searched(spark, rows, []) == [] and searched(spark, [], [(1, "tax", "x")]) == []


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    by_item = defaultdict(list)
    for r in queries.QUERIES["op11_lexical_buckets"](spark, SF).collect():
        by_item[r["item_id"]].append((r["item_id"], r["rank"], r["doc_id"], r["score"]))
    assert sorted(sum(by_item.values(), []), key=repr) == sorted(brute_force(docs, items), key=repr)
