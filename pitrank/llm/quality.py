"""Quality rules for filing documents: how far a text's histograms are from those of its language.

Records: filing documents (``filing_id``, ``document``, ``language``).
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kinds import BOOLEAN, DOUBLE, LONG, STRING, rows, struct
from .words import WordHashes, words_of
from .worker import held, key_of

# Symbols, and the character classes of the histograms.
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "symbol", "punctuation", "other")

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COMMON_SHARE = 0.002       # a common word has at least this share of its language's words: at most 500 of them
FLUSH_WORDS = 300_000      # distinct words and bytes of text after which a task hands on its sums
FLUSH_BYTES = 64 << 20


def _class_table() -> np.ndarray:
    """Class of each byte; bytes inside a longer character have none (one past the last)."""
    table = np.full(256, len(CLASSES), np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b] = CLASSES.index("other")
        elif b < 0x80:
            name = ("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else
                    "line" if c == "\n" else "space" if c in " \t\r\x0b\x0c" else
                    "symbol" if b in SYMBOLS else "punctuation")
            table[b] = CLASSES.index(name)
    return table


_CLASS = _class_table()


@dataclass(frozen=True)
class Divergence:
    """Limits of the rule. A histogram of too few characters or common words is no evidence and is not judged.

    Common words hold only a part of a language's words, so the word distance of a text without any of them is bounded
    by that part. ``min_common`` is a limit of its own: the least share of common words, as a part of the language's.
    It is not judged where a text of that length should hold fewer than ``min_expected`` of them.
    """
    max_characters: float = 0.30
    max_words: float = 0.45
    min_common: float = 0.2
    min_expected: float = 10
    min_characters: int = 200
    min_words: int = 50


def character_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)]


def lowered_words(text: bytes) -> list[bytes]:
    return words_of(text.lower())


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (root of the divergence, base 2, 0 to 1) of a histogram to each row of q; rows are shares."""
    total = p.sum()
    if not total:
        return np.ones(len(q))
    p = p / total
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


HISTOGRAM = struct(language=STRING, kind=STRING, bin=LONG, n=LONG)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each task: characters by class and words by hash, per language.

    They are handed on after the text with which they grow large, so a batch's size does not matter.
    """
    hashes = WordHashes()
    characters: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        kinds, langs, bins, counts = [], [], [], []
        for lang, c in characters.items():
            kinds += ["character"] * len(CLASSES)
            langs += [lang] * len(CLASSES)
            bins.append(np.arange(len(CLASSES)))
            counts.append(c)
        for lang, c in words.items():
            kinds += ["word"] * len(c)
            langs += [lang] * len(c)
            bins.append(hashes.of(list(c)).view(np.int64))
            counts.append(np.fromiter(c.values(), np.int64, len(c)))
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(kinds, pa.string()),
                                           pa.array(np.concatenate([none, *bins])),
                                           pa.array(np.concatenate([none, *counts]))], names=HISTOGRAM.names)

    n_words = n_bytes = 0
    for batch in batches:
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            text, lang = text.as_py() or b"", lang.as_py()
            characters[lang] = characters.get(lang, 0) + character_counts(text)
            counter = words.setdefault(lang, Counter())
            n_words -= len(counter)
            counter.update(lowered_words(text))
            n_words += len(counter)
            n_bytes += len(text)
            if n_words > FLUSH_WORDS or n_bytes > FLUSH_BYTES:
                yield out()
                characters, words, n_words, n_bytes = {}, {}, 0, 0
    yield out()


@dataclass(frozen=True)
class References:
    """Histograms of each language as shares. Words: the common ones' hashes, and the share of all others last."""
    languages: list[str]
    characters: np.ndarray
    words: list[dict[int, int]]
    word_shares: list[np.ndarray]


def common_bins(filings: DataFrame) -> DataFrame:
    """Counts of every character class and of the common words of each language, beside the language's words (``_words``).

    The sums by word are shuffled once and read twice, for the languages' words and for the common ones; no table of them
    is written. The condition on ``kind`` stands inside the sum, as a filter would make the two shuffles different ones.
    """
    counts = (filings.where("language IS NOT NULL AND document IS NOT NULL").select("document", "language")
              .mapInArrow(_histograms, HISTOGRAM).groupBy("language", "kind", "bin").agg(F.sum("n").alias("n")))
    # partial sums by language first: the language with most words is no crowded key
    words_of_language = (counts.groupBy("language")
                         .agg(F.sum(F.when(F.col("kind") == "word", F.col("n"))).alias("_words")))
    return (counts.join(F.broadcast(words_of_language), "language").where("_words IS NOT NULL")
            .where((F.col("kind") == "character") | (F.col("n") >= COMMON_SHARE * F.col("_words"))))


def language_references(filings: DataFrame) -> References:
    """Character-class and common-word histograms of every language, over all filings whose language is known.

    Tasks sum their own words before the shuffle. A common word has COMMON_SHARE of its language's words, so there are
    at most 1 / COMMON_SHARE of them; every language has a reference, however few its words are among all. What comes to
    the driver is bounded by the number of languages. NULL and wordless documents, and those of unknown language, do not
    count; an empty table gives no references.
    """
    rows_of: dict[str, list] = {}
    for r in common_bins(filings).collect():
        rows_of.setdefault(r["language"], []).append(r)
    languages = sorted(rows_of)
    characters, words, shares = [], [], []
    for lang in languages:
        c = np.zeros(len(CLASSES))
        common = sorted((r["bin"], r["n"]) for r in rows_of[lang] if r["kind"] == "word")
        for r in rows_of[lang]:
            if r["kind"] == "character":
                c[r["bin"]] = r["n"]
        total = rows_of[lang][0]["_words"]
        characters.append(c / c.sum())
        words.append({b: i for i, (b, _) in enumerate(common)})
        s = np.array([n for _, n in common] + [total - sum(n for _, n in common)], float)
        shares.append(s / s.sum())
    return References(languages, np.array(characters).reshape(len(languages), len(CLASSES)), words, shares)


MEASURES = struct(n_words=LONG, word_chars=LONG, n_symbols=LONG, n_dup_lines=LONG, n_repeat_words=LONG,
                  base_failed=BOOLEAN, language=STRING, character_distance=DOUBLE, word_distance=DOUBLE, kept=BOOLEAN)


def repeated_window_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more. ``words``: a number per word, equal for equal words."""
    n = len(words) - 2
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        w = (words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:n + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
        w = (w ^ (w >> np.uint64(31))) + words[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k:n + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if words_of(line):
            n += line in seen
            seen.add(line)
    return n


class Judge:
    def __init__(self, references: References, limits: Divergence):
        self.references, self.limits, self.hashes = references, limits, WordHashes()
        # languages and places of each common word, and each language's distance to a text without any of its words
        self.places: dict[int, list[tuple[int, int]]] = {}
        for i, words in enumerate(references.words):
            for b, k in words.items():
                self.places.setdefault(int(np.uint64(np.int64(b))), []).append((i, k))
        self.foreign = [float(jensen_shannon(np.eye(1, len(s), len(s) - 1)[0], s[None])[0]) for s in references.word_shares]
        self.expected = [float(1 - s[-1]) for s in references.word_shares]

    def distances(self, text: bytes) -> tuple[str | None, float | None, float | None, float, float]:
        """Nearest language, both distances to it, the text's common words and how many it should have by its length.

        Nothing where no reference is there.
        """
        ref = self.references
        if not ref.languages:
            return None, None, None, 0.0, 0.0
        words = Counter(self.hashes.of(lowered_words(text)).tolist())
        n_words = words.total()
        histograms: dict[int, np.ndarray] = {}
        for w, n in words.items():
            for i, k in self.places.get(w, ()):
                if i not in histograms:
                    histograms[i] = np.zeros(len(ref.word_shares[i]))
                histograms[i][k] = n
        of_characters = jensen_shannon(character_counts(text), ref.characters)

        def distance(i: int) -> tuple:
            h, common = histograms.get(i), 0.0
            by_word = self.foreign[i]
            if h is not None:
                common = float(h.sum())
                h[-1] = n_words - common
                by_word = float(jensen_shannon(h, ref.word_shares[i][None])[0])
            return by_word, float(of_characters[i]), ref.languages[i], common, n_words * self.expected[i]

        best = min(map(distance, range(len(ref.languages))))
        return best[2], best[1], best[0], best[3], best[4]

    def measure(self, text: bytes) -> tuple:
        words = words_of(text)
        n = len(words)
        word_chars = len(b"".join(words).decode("utf-8", "replace")) if not text.isascii() else sum(map(len, words))
        repeats = repeated_window_words(self.hashes.of(words))
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        lang, by_character, by_word, common, expected = self.distances(text) if n else (None, None, None, 0.0, 0.0)
        p = self.limits
        far = lang is not None and (
            (len(text) >= p.min_characters and by_character > p.max_characters)
            or (n >= p.min_words and by_word > p.max_words)
            or (n >= p.min_words and expected >= p.min_expected and common < p.min_common * expected))
        return (n, word_chars, sum(text.count(bytes([s])) for s in SYMBOLS), duplicate_lines(text), repeats, failed,
                lang, by_character, by_word, not failed and not far)


def quality(document: Column | str, references: References, limits: Divergence = Divergence()) -> Column:
    """Struct of counts, distances and the verdict for a filing's text.

    Base rules: fewer than MIN_WORDS words, or more than half of the words in repeated 3-word windows, fail. Other
    texts are compared with every language's reference; the nearest counts, and a text is kept unless its character
    classes or its common words are farther from it than the limits allow, or it holds far too few common words.
    Histograms of few characters or words are not judged, and without references every text that passes the base rules
    is kept. NULL and empty texts have no words and fail. Whole texts are read; repeated rows get equal results; other columns are not looked at.
    """
    key = key_of("quality", references, limits)

    @F.arrow_udf(MEASURES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = held(key, lambda: Judge(references, limits))
        for batch in batches:
            yield rows(MEASURES, [judge.measure(t.as_py() or b"") for t in batch.cast(pa.binary())])
    return run(document)
