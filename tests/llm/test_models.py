import random

import numpy as np
import pytest

from pitrank.llm import gru, language as L, toxicity as X
from pyspark.sql import functions as F

from texts import filings, odd_rows, prose, table


def labelled(n: int, seed: int):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words, toxic = prose(r.randint(30, 200), seed + i).split(), i % 4 == 0
        for _ in range(max(3, len(words) // 30) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["crook", "fraudster", "scoundrel"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_rows_not_learned_from(spark):
    rows = labelled(400, 10)
    docs = filings(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (999, 1), (5, 7)],
                                   "filing_id bigint, toxic int")
    model = X.fit(docs, labels, X.Ftrl(per_class=120))
    again = X.fit(docs, labels, X.Ftrl(per_class=120))
    assert np.array_equal(model[0], again[0]) and np.array_equal(model[1], again[1])
    assert 0 < len(model[0]) < 5000
    score = dict(table(docs.select("filing_id", X.toxicity("document", *model).alias("s"))))
    right = sum((score[i] >= 0.5) == bool(y) for i, _, y in rows[300:])
    assert right >= 98


def test_toxicity_of_odd_rows(spark):
    rows = labelled(80, 3)
    docs = filings(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "filing_id bigint, toxic int")
    model = X.fit(docs, labels)
    odd = filings(spark, odd_rows())
    got = table(odd.select("filing_id", X.toxicity("document", *model).alias("s")))
    assert len(got) == 9 and all(0 <= s <= 1 for _, s in got)
    empty = {s for i, s in got if i in (2, 3, 5)}
    assert len(empty) == 1 and empty.pop() < 0.5
    nothing = X.fit(docs, labels.limit(0))
    assert len(nothing[0]) == 0
    assert {s for _, s in table(docs.select("filing_id", X.toxicity("document", *nothing)))} == {0.5}
    assert odd.limit(0).select(X.toxicity("document", *model)).count() == 0


def test_sample_is_bounded_and_weighted(spark):
    rows = labelled(100, 5)
    docs = filings(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "filing_id bigint, toxic int")
    sample = X.learning_sample(docs, labels, 10).groupBy("toxic").agg(F.count("*"), F.max("weight")).collect()
    by = {r[0]: r[1:] for r in sample}
    assert by[0][0] == by[1][0] == 10
    assert by[0][1] / by[1][1] == pytest.approx(3.0)


def test_gradients_of_the_network():
    m = gru.new_model(4, 3)
    r = np.random.default_rng(0)
    windows, labels = r.integers(0, 256, (5, 6)).astype(np.uint8), r.integers(0, 3, 5)
    _, grad = gru.loss_and_gradient(m, windows, labels)
    for k in m:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        moved = []
        for e in (1e-2, -1e-2):
            other = {q: v.copy() for q, v in m.items()}
            other[k][at] += e
            moved.append(gru.loss_and_gradient(other, windows, labels)[0])
        assert (moved[0] - moved[1]) / 2e-2 == pytest.approx(grad[k][at], rel=0.02)


def test_reader_is_the_trained_network():
    m = gru.new_model(5, 3)
    windows = np.random.default_rng(1).integers(0, 256, (7, gru.WINDOW)).astype(np.uint8)
    _, states, _, _ = gru.forward(m, windows)
    ahead, back = gru._aligned(states)
    want = gru._softmax(ahead @ m["w"][0] + back @ m["w"][1] + m["d"]).sum(axis=0)
    got = gru.Reader(m, batch=3).window_probabilities(windows, np.full(7, gru.WINDOW))
    assert np.allclose(got, want, atol=1e-4)
    # padding says nothing: two texts that differ in padding only
    a = windows[:1].copy()
    a[0, 20:] = 0
    b = a.copy()
    b[0, 20:] = 65
    r = gru.Reader(m)
    assert np.allclose(r.window_probabilities(a, np.array([20])), r.window_probabilities(b, np.array([20])), atol=1e-5)


def test_language_on_rows_not_learned_from(spark):
    def text(k, i):
        r = random.Random(f"{k}{i}")
        syllables = (["the", "ing", "ion", "sh"], ["ung", "sch", "ein", "öß"])[k]
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 80)))
    rows = [(2 * i + k, text(k, i), ("en", "de")[k]) for i in range(120) for k in (0, 1)]
    learned = filings(spark, rows[:160] + [(900, "zzz", None)])
    p = gru.Gru(steps=40, batch=64, per_language=60)
    names, model = L.fit(learned, p)
    assert names == ["de", "en"]
    docs = filings(spark, rows[160:] + odd_rows() + [(950, "123 456 !")])
    got = table(docs.select("filing_id", "language", L.language_of("document", names, model).alias("p"))
                .select("filing_id", "language", "p.*"))
    held = [x for x in got if x[0] is not None and x[0] > 100 and x[0] < 900]
    assert sum(x[1] == x[2] for x in held) >= 0.95 * len(held)
    assert {(x[2], x[3]) for x in got if x[0] in (2, 3, 5, 950)} == {("und", 0.0)}
    assert all(0 <= x[3] <= 1 for x in got) and len(got) == len(rows[160:]) + 10
    assert {x[0] for x in table(docs.select(L.language_of("document", [], {})["language"]))} == {"und"}
    assert L.fit(learned.limit(0), p)[0] == []


def test_every_language_is_learned(spark):
    """250 languages: none is left out for being one of many."""
    from pitrank.llm import language as G
    from pitrank.llm.gru import Gru
    docs = filings(spark, [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 40, f"l{i:03d}") for i in range(250)])
    languages, model = G.fit(docs, Gru(steps=3, windows=1))
    assert languages == [f"l{i:03d}" for i in range(250)] and model
