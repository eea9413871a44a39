import random

from pitrank.llm import decontaminate as D

from texts import filings, odd_rows, prose, table


def distance(pattern: str, text: str) -> int:
    """Smallest edit distance of the pattern to any stretch of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != c))
    return min(row)


def test_myers_is_edit_distance():
    r = random.Random(3)
    for _ in range(200):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        item = D.Item(1, a, 0)
        for i, c in enumerate(a):
            item.masks[c] = item.masks.get(c, 0) | 1 << i
        assert D.myers(item, t, 0, len(t))[0] == min(len(a), distance(a, t))


def edited(text: str, n: int, r: random.Random) -> str:
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        r.choice([lambda: out.insert(i, "q"), lambda: out.pop(i), lambda: out.__setitem__(i, "z")])()
    return "".join(out)


def test_against_brute_force(spark):
    r = random.Random(5)
    items = [(k, prose(r.randint(5, 40), 100 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "goodwill")]
    docs = []
    for i in range(60):
        k = r.randrange(12)
        text = items[k][1]
        n = r.choice([0, 1, len(text) // 20, len(text) // 8])
        docs.append((i, prose(40, 500 + i) + ". " + edited(text, n, r).upper() + "\n" + prose(30, 900 + i)))
    got = {(x[0], x[1]): x[2] for x in table(D.contaminated(
        filings(spark, docs), spark.createDataFrame(items, "item_id bigint, item string")))}
    want = {}
    for i, text in docs:
        text = D.normalize(text)
        for k, item in items[:12]:
            item = D.normalize(item)
            d = distance(item, text)
            if d <= int(D.ERROR_RATE * len(item)):
                want[i, k] = d
        if " goodwill " in f" {text} ":
            want[i, 52] = 0
    assert got == want
    assert any(0 < d for d in want.values())


def test_odd_rows_and_blocks(spark):
    docs = filings(spark, odd_rows())
    items = spark.createDataFrame([(1, prose(120, 2)[30:300]), (2, prose(30_000, 1)[99_000:99_300]), (3, None)],
                                  "item_id bigint, item string")
    got = D.contaminated(docs, items)
    assert [x[:3] for x in table(got)] == [(1, 1, 0), (1, 1, 0), (4, 2, 0)]
    assert sorted(map(len, D.item_blocks(items, chars=1))) == [1, 1]
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), items).count() == 0
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == 6
