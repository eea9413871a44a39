import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from pitrank.llm import quality as Q

from texts import filings, odd_rows, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r,
            n < 50 or 100 * r > 50 * n)


def test_counts_and_verdicts(spark):
    good = [(100 + i, prose(150, i), "en") for i in range(40)]
    rows = good + [(i, t, lang) for i, t, lang, *_ in odd_rows()] + [
        (20, "a b c a b c a b c", "en"), (21, "x\nx\n \n \nx y\nz", "en"), (22, prose(60, 1) + "\n" + prose(60, 1), "en"),
        (23, "é # ü $$ <b> " + prose(80, 9), "en"), (24, " | ".join("q#%z" for _ in range(300)), "en"),
        (25, "\x1cword\x0bnext\x0cpage " + prose(70, 2), None)]
    docs = filings(spark, rows)
    ref = Q.language_references(docs)
    assert "en" in ref.languages
    got = {r[0]: r[1:] for r in table(docs.select("filing_id", Q.quality("document", ref).alias("q"))
                                      .select("filing_id", "q.*"))}
    for i, text, *_ in rows:
        assert got[i][:6] == plain(text), i
    assert all(got[i][-1] for i, *_ in good)
    assert not any(got[i][-1] for i in (2, 3, 5, 20, 22, 24))


def test_histograms_are_sums_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "COMMON_SHARE", 0.04)
    rows = [(i, prose(40 + i, i) + (" Rare%d" % i), "en") for i in range(50)] + [(99, "und ein und", "de"), (98, "x", None)]
    ref = Q.language_references(filings(spark, rows))
    en = " ".join(t for _, t, lang in rows if lang == "en").lower().split()
    common = {w: n for w, n in Counter(en).items() if n >= 0.04 * len(en)}
    i = ref.languages.index("en")
    from pitrank.llm.words import WordHashes
    hashes = WordHashes().of([w.encode() for w in common]).view(np.int64).tolist()
    shares = {b: ref.word_shares[i][k] for b, k in ref.words[i].items()}
    assert shares.keys() == set(hashes)
    for w, h in zip(common, hashes):
        assert abs(shares[h] - common[w] / len(en)) < 1e-12
    chars = sum(Q.character_counts(t.encode()) for _, t, lang in rows if lang == "en")
    assert np.allclose(ref.characters[i], chars / chars.sum())


def test_jensen_shannon():
    p = np.array([1, 1, 0.0])
    assert np.allclose(Q.jensen_shannon(p, np.array([[0.5, 0.5, 0], [0, 0, 1]])), [0, 1])
    assert Q.jensen_shannon(np.zeros(3), np.array([[1.0, 0, 0]]))[0] == 1


def test_without_references(spark):
    none = Q.language_references(filings(spark, [(1, None, "en"), (2, "a", None)]))
    assert none.languages == []
    docs = filings(spark, [(1, prose(80, 1)), (2, "short"), (3, None)])
    got = table(docs.select("filing_id", Q.quality("document", none)["kept"]))
    assert got == [(1, True), (2, False), (3, False)]
    assert docs.limit(0).select(Q.quality("document", none)).count() == 0


def test_short_texts_are_not_judged_by_histograms():
    ref = Q.References(["en"], np.array([[1.0] + [0] * 7]), [{}], [np.array([1.0])])
    far = ("1234 " * 45 + "a b c d e f g").encode()
    strict = Q.Divergence(0.1, 0.1, min_characters=10, min_words=10)
    guarded = Q.Divergence(0.1, 0.1, min_characters=1000, min_words=1000)
    text = " ".join(str(i) for i in range(60)).encode()
    assert far and not Q.Judge(ref, strict).measure(text)[-1] and Q.Judge(ref, guarded).measure(text)[-1]


def test_texts_without_common_words_are_rejected():
    """Common words hold 29 % of the language: their absence is a distance of 0.40 only, below the limit on distances."""
    from pitrank.llm.words import WordHashes
    common = [f"w{i}".encode() for i in range(40)]
    hashes = WordHashes().of(common).view(np.int64).tolist()
    shares = np.array([0.29 / 40] * 40 + [0.71])
    text = " ".join(f"gibber{i}," for i in range(200)).encode()
    classes = Q.character_counts(text) / Q.character_counts(text).sum()
    judge = Q.Judge(Q.References(["en"], classes[None], [dict(zip(hashes, range(40)))], [shares]), Q.Divergence())
    assert 0.39 < judge.distances(text)[2] < 0.45
    assert not judge.measure(text)[-1]
    r = np.random.default_rng(3)
    good = [[common[r.integers(40)].decode() if r.random() < 0.29 else f"gibbes{r.integers(1000)}," for _ in range(n)]
            for n in (50, 60, 200, 2000) for _ in range(40)]
    measured = [judge.measure(" ".join(g).encode()) for g in good]
    assert all(m[-1] for m in measured), [m for m in measured if not m[-1]]
    # a language of rare words only is no evidence
    thin = Q.Judge(Q.References(["zh"], classes[None], [{hashes[0]: 0}], [np.array([0.01, 0.99])]), Q.Divergence())
    assert thin.measure(text)[-1]


def test_a_rare_language_has_a_reference_of_its_own(spark):
    """Three clean texts in another script, a two-thousandth of all words, are kept; gibberish of that script is not compared
    with Latin references only."""
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    r = random.Random(4)
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(60)]
    greek = [(10_000 + i, " ".join(r.choice(words) for _ in range(200)) + ".", "el") for i in range(3)]
    docs = filings(spark, [(i, prose(400, i), "en") for i in range(3000)] + greek)
    verdict = Q.quality("document", Q.language_references(docs))
    got = {x[0]: (x[1], x[2]) for x in docs.where("filing_id >= 10000").select("filing_id", verdict.alias("q"))
           .select("filing_id", "q.language", "q.kept").collect()}
    assert got == {i: ("el", True) for i, _, _ in greek}


def test_references_leave_no_table_and_shuffle_the_words_once(spark):
    """A table of every distinct word went to the shared folder: a file for each shuffle partition, each with its own processes."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    docs = filings(spark, [(i, prose(60, i), "en") for i in range(20)] + [(30, " \n", "de"), (31, "ein und", "fr"), (32, None, "es")])
    assert Q.language_references(docs).languages == ["en", "fr"]
    assert set(os.listdir(folder)) == before
    found = Q.common_bins(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 1


def test_sums_are_handed_on_within_a_batch(monkeypatch):
    """A batch of many rare words, or of much text, is no bound on what a task holds."""
    texts = [" ".join(f"w{i}_{k}" for k in range(100)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", "de"] * 20)], names=["document", "language"])

    def sums():
        out = list(Q._histograms(iter([batch])))
        total = Counter()
        for r in pa.Table.from_batches(out).to_pylist():
            total[r["language"], r["kind"], r["bin"]] += r["n"]
        return max(o.num_rows for o in out), total

    _, whole = sums()
    monkeypatch.setattr(Q, "FLUSH_WORDS", 450)
    rows, parts = sums()
    assert rows <= 500 + 2 * len(Q.CLASSES) and parts == whole
    monkeypatch.setattr(Q, "FLUSH_WORDS", 300_000)
    monkeypatch.setattr(Q, "FLUSH_BYTES", 1000)
    rows, parts = sums()
    assert rows <= 200 + 2 * len(Q.CLASSES) and parts == whole


def test_long_words_are_not_remembered():
    from pitrank.llm.words import WordHashes
    hashes, words = WordHashes(), [b"word", b"x" * 10_000, b"word", b"x" * 10_000]
    assert hashes.of(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert list(hashes) == [b"word"]
