"""Toxicity of filing documents: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Records: filing documents (``filing_id``, ``document``) and reviewed labels (``filing_id``, ``toxic`` 0 or 1).
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .kinds import DOUBLE, INT, struct
from .words import HASH_SLOTS, likely_first, mix
from .worker import held, key_of

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)   # first characters of a word, a stem where words are compounds
SKIPS = (1, 2, 3)      # distance of the two words of a gram: 1 is the bigram, larger ones are skip-grams

WEIGHTS = struct(slot=INT, weight=DOUBLE)


@dataclass(frozen=True)
class Ftrl:
    """Learning parameters. ``per_class`` bounds the labelled rows of each class that are learned from, ``max_chars`` the
    characters of their texts together: of more, those with the smallest hashes that fit are taken."""
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0
    epochs: int = 6
    per_class: int = 2000
    max_chars: int = 20_000_000


class WordGrams:
    """Hashed features of texts. Words are hashed once per worker, up to a bound."""

    def __init__(self, bits: int, limit: int = 150_000):
        self._mask = np.uint64((1 << bits) - 1)
        self._limit = limit
        self._ids: dict[str, int] = {}
        self._table = np.empty((limit, 1 + len(STEMS)), np.uint64)

    def _id(self, word: str) -> int:
        i = self._ids.get(word)
        if i is None:
            i = self._ids[word] = len(self._ids)
            if i == len(self._table):
                self._table = np.concatenate([self._table, np.empty_like(self._table)])
            digest = xxhash.xxh3_64_intdigest
            self._table[i] = (digest(word.encode()), *(digest(f"{k}:{word[:k]}".encode()) for k in STEMS))
        return i

    def words(self, text: str) -> np.ndarray:
        """One row of hashes per word: the word's and its stems'."""
        if len(self._ids) > self._limit - 10_000:
            self._ids = {}
        found = WORD.findall(text.lower())
        ids = np.fromiter(map(self._id, found), dtype=np.int64, count=len(found))
        return self._table[ids]

    def slots(self, text: str) -> tuple[np.ndarray, int]:
        """Slots of all grams, repeats included, and the number of words."""
        h = self.words(text)
        word = h[:, 0]
        pairs = [mix(word[:-k] * np.uint64(2 * k + 1) + mix(word[k:] + np.uint64(k))) for k in SKIPS]
        return (np.concatenate([h.ravel(), *pairs]) & self._mask).astype(np.int32), len(h)


def strength(counts: np.ndarray, n_words: int) -> np.ndarray:
    """Feature value of a gram's count: near 0 for a stray word in a long text, towards 1 where it is frequent."""
    return counts / (counts + 1.0 + 0.002 * n_words)


def features(grams: WordGrams, text: str) -> tuple[np.ndarray, np.ndarray]:
    slots, n = grams.slots(text)
    slots, counts = np.unique(slots, return_counts=True)
    return slots, strength(counts, n).astype(np.float32)


def train(examples: list[tuple[str, int]], weights: tuple[float, float], p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero; the last slot is the bias. ``weights``: of an example of class 0 and 1."""
    grams, size = WordGrams(p.bits), 1 << p.bits
    # grams of a single example can't be told from chance; they are left out before anything is kept
    seen = np.zeros(size, np.int32)
    for t, _ in examples:
        seen[np.unique(grams.slots(t)[0])] += 1
    rows = []
    for t, y in examples:
        s, x = features(grams, t)
        k = seen[s] > 1
        rows.append((s[k], x[k], y))
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)
    bias = np.array([size], np.int32)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            s, x, y = rows[i]
            s, x = np.concatenate([s, bias]), np.append(x, 1.0)
            zs, ns = z[s], n[s]
            l1 = np.where(s == size, 0.0, p.l1)
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((p.beta + np.sqrt(ns)) / p.alpha + p.l2))
            g = (sigmoid(w @ x) - y) * weights[y] * x
            rate = (np.sqrt(ns + g * g) - np.sqrt(ns)) / p.alpha
            z[s] = zs + g - rate * w
            n[s] = ns + g * g
    l1 = np.full(size + 1, p.l1)
    l1[size] = 0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    slots = np.flatnonzero(w)
    return slots, w[slots]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    def __init__(self, slots: np.ndarray, weights: np.ndarray, bits: int):
        self.bias = float(weights[slots == 1 << bits].sum())
        self.weight = np.zeros(1 << bits, np.float32)
        inside = slots < 1 << bits
        self.weight[slots[inside]] = weights[inside]
        self.grams = WordGrams(bits)

    def score(self, text: str) -> float:
        slots, n = self.grams.slots(text)
        slots, counts = np.unique(slots[self.weight[slots] != 0], return_counts=True)
        return float(sigmoid(self.bias + self.weight[slots] @ strength(counts, n)))


def learning_sample(filings: DataFrame, labels: DataFrame, per_class: int, max_chars: int = Ftrl.max_chars) -> DataFrame:
    """(document, toxic, weight): at most ``per_class`` labelled filings of each class, chosen by a hash of their id.

    ``weight`` restores the share of the class. The chosen ids are bounded, so they are broadcast; texts aren't
    shuffled but for the sample. Labels other than 0 and 1, NULL ids and documents without a label are left out.
    A filing labelled twice counts as its larger label; of texts with one id the smallest is learned from.
    """
    known = (labels.where("toxic IN (0, 1) AND filing_id IS NOT NULL")
             .groupBy("filing_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, n in sorted(sizes.items()):
        part = (known.where((F.col("toxic") == y) & likely_first("filing_id", per_class, n))
                .orderBy(F.pmod(F.xxhash64("filing_id"), F.lit(HASH_SLOTS)), "filing_id").limit(per_class)
                .withColumn("weight", F.lit(n / min(n, per_class) * len(sizes) / sum(sizes.values()) * per_class / 2)))
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return filings.select("document", F.lit(0).alias("toxic"), F.lit(1.0).alias("weight")).limit(0)
    # one text per id, however often a labelled id is repeated; then a class is no more than per_class rows
    texts = (filings.select("filing_id", "document").join(F.broadcast(chosen), "filing_id")
             .groupBy("filing_id", "toxic", "weight").agg(F.min("document").alias("document")))
    upto = (Window.partitionBy("toxic").orderBy(F.pmod(F.xxhash64("filing_id"), F.lit(HASH_SLOTS)), "filing_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (texts.withColumn("_upto", F.sum(F.coalesce(F.length("document"), F.lit(0))).over(upto))
            .where(F.col("_upto") <= max_chars // 2).select("filing_id", "document", "toxic", "weight"))


def fit(filings: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Learns weights from a bounded sample, in one task; the result has at most 2 ** bits entries, few are not zero.

    Rows without label, id or text teach nothing or an empty text; without labels the model is empty. Other columns are
    not read."""
    sample = learning_sample(filings, labels, p.per_class, p.max_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        # a sample row may be repeated in the input; its id orders it, so that runs agree
        rows.sort(key=lambda r: (r["filing_id"], r["document"] or ""))
        scale = sum(r["weight"] for r in rows) / len(rows)
        weight = [next((r["weight"] / scale for r in rows if r["toxic"] == y), 1.0) for y in (0, 1)]
        slots, w = train([(r["document"] or "", r["toxic"]) for r in rows], (weight[0], weight[1]), p)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(w)], names=WEIGHTS.names)

    found = sample.repartition(1).mapInArrow(run, WEIGHTS).collect()
    return np.array([r["slot"] for r in found], dtype=np.int64), np.array([r["weight"] for r in found])


def toxicity(document: Column | str, slots: np.ndarray, weights: np.ndarray, bits: int = Ftrl.bits) -> Column:
    """Probability that a filing's text is toxic.

    Texts are read whole; NULL, empty and wordless texts get the model's base rate, which is also what a model
    without any examples gives (0.5). Repeated rows get equal scores and other columns are not looked at.
    """
    key = key_of("toxicity", slots, weights, bits)

    @F.arrow_udf(DOUBLE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held(key, lambda: Scorer(slots, weights, bits))
        for batch in batches:
            yield pa.array([scorer.score(t.as_py() or "") for t in batch], type=pa.float64())
    return run(document)
