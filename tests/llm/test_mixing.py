import itertools
import random

import pytest
from pyspark.sql import functions as F

from pitrank.llm import flow, mixing as M

from texts import filings, odd_rows, prose, table


def water(sizes, weights, total, copies):
    """Reshares what is above the limit, again and again."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= copies * sizes[s]:
                left += target[s] - copies * sizes[s]
                target[s] = copies * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_choice(spark):
    r = random.Random(1)
    sources = ["b", "a", "é", "Z", None]
    rows = [(i, prose(r.randint(1, 200), i), "en", [sources[min(4, r.randrange(8))]]) for i in range(400)]
    got = table(M.mixture(filings(spark, rows)))
    assert got == table(M.mixture(filings(spark, rows[::-1])))
    source = {i: s[0] for i, _, _, s in rows}
    size = {i: len(t.split()) for i, t, *_ in rows}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in sources}
    order = sorted([s for s in sources if s is not None]) + [None]
    want = water(total, dict(zip(order, [3, 1, 2, 3, 1])), 1.5 * sum(total.values()), 2)
    taken = dict.fromkeys(sources, 0)
    for i, n, source_size, target, t, copies in got:
        s = source[i]
        assert n == size[i] and source_size == total[s] and target == pytest.approx(want[s])
        assert t == copies * n and 0 <= copies <= 2
        taken[s] += t
    for s in sources:
        assert abs(taken[s] - want[s]) <= 3
    mixed = M.mixed_filings(filings(spark, rows))
    counts = dict(table(mixed.groupBy("filing_id").count()))
    assert counts == {g[0]: g[5] for g in got if g[5]}


def best_flow(patterns, targets):
    """Most words, then fewest second copies, over all whole-number flows."""
    arcs = [(i, s) for i, (names, _) in enumerate(patterns) for s in names]
    best = None
    for x in itertools.product(*[range(2 * patterns[i][1] + 1) for i, _ in arcs]):
        give = [sum(v for v, (i, _) in zip(x, arcs) if i == k) for k in range(len(patterns))]
        get = {s: sum(v for v, (_, q) in zip(x, arcs) if q == s) for s in targets}
        if all(g <= 2 * p[1] for g, p in zip(give, patterns)) and all(get[s] <= targets[s] for s in targets):
            score = (sum(give), -sum(max(0, g - p[1]) for g, p in zip(give, patterns)))
            best = score if best is None or score > best else best
    return best


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(25):
        patterns = [(["x"], r.randint(0, 2)), (["y"], r.randint(0, 2)), (["x", "y"], r.randint(0, 2))]
        targets = {"x": r.randint(0, 5), "y": r.randint(0, 5)}
        got = flow.route([(n, float(s)) for n, s in patterns], targets, [1, 3])
        give = [sum(f.values()) for f in got]
        assert (sum(give), -sum(max(0, g - p[1]) for g, p in zip(give, patterns))) == best_flow(patterns, targets)


def test_overlapping_sources(spark):
    rows = [(i, prose(50, i), "en", [["A"], ["B"], ["A", "B"], ["C"]][i % 4]) for i in range(400)]
    p = M.Mix(weights=(4, 1, 1))
    got = M.mixture(filings(spark, rows), p)
    pattern = {i: tuple(x) for i, _, _, x in rows}
    taken: dict = {}
    for i, n, _, _, t, _ in table(got):
        taken[pattern[i]] = taken.get(pattern[i], 0) + t
    # A wants 20000 (its limit), B and C 5000 each: A takes all of its own and of the shared filings twice, B its own
    assert sum(taken.values()) == pytest.approx(1.5 * 20_000, abs=60)
    assert taken[("A",)] == 10_000
    assert taken[("A", "B")] == pytest.approx(10_000, abs=60)


def test_odd_rows(spark):
    got = table(M.mixture(filings(spark, odd_rows())))
    assert len(got) == 9
    assert all(0 <= g[4] <= 2 * g[1] and g[5] <= 2 for g in got)
    assert {g[1] for g in got if g[0] in (2, 3, 5)} == {0}
    ones = [g for g in got if g[0] == 1]
    assert ones[0] == ones[1]
    assert M.mixture(filings(spark, [])).count() == 0
    zero = table(M.mixture(filings(spark, [(1, "", None, ["a"]), (2, None, None, ["b"])])))
    assert [g[3] for g in zero] == [0.0, 0.0]
    docs = filings(spark, odd_rows())
    assert M.mixed_filings(docs).columns == docs.columns
    assert M.mixed_filings(docs.limit(0)).count() == 0


def test_words_are_counted_whole(spark):
    df = spark.createDataFrame([(t,) for t in ("a b", None, "", " ", "x\x1cy z", "q r", "one\x0btwo\x0cthree")], "t string")
    assert [r[0] for r in df.select(M.n_words("t")).collect()] == [2, 0, 0, 0, 2, 1, 3]
    assert df.where(F.length("t") > 99).count() == 0


def test_a_giant_filing_does_not_leave_a_gap(spark):
    """The filing at the crossing is larger than what is missing: the shorter ones behind it are taken, not three only."""
    docs = [(i, "w " * 20, "en", ["a"]) for i in range(300)] + [(900, "w " * 12_000, "en", ["a"])]
    docs += [(901, "w " * 15, "en", ["a"]), (901, "w " * 25, "en", ["a"])]
    for seed in (1,):
        p = M.Mix(weights=(1,), share=1.25, seed=seed)
        got = table(M.mixture(filings(spark, docs), p))
        assert abs(sum(g[4] for g in got) - got[0][3]) <= 20
        assert len({g[5] for g in got if g[0] == 901}) == 1
    counts = dict(table(M.mixed_filings(filings(spark, docs), p).groupBy("filing_id").count()))
    assert counts == {g[0]: g[5] for g in got if g[0] != 901} | {901: 2 * next(g[5] for g in got if g[0] == 901)}
