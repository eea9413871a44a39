"""Benchmark decontamination of filing documents by pigeonhole edit matching.

Records: filing documents (``filing_id``, ``document``) and evaluation items (``item_id``, ``item``). Evaluation items
are no records of the reference project; any table of held-out texts will do.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import materialize
from .kinds import INT, LONG, struct
from .worker import held, key_of

WORD = re.compile(r"\w+")
ERROR_RATE = 0.05      # edits allowed per character of an item
SHORT_CHARS = 20       # items shorter than this are matched exactly, on word boundaries
BLOCK_CHARS = 4_000_000

MATCHES = T.ArrayType(struct(item_id=LONG, distance=INT, start=INT, stop=INT))


def normalize(text: str) -> str:
    """Lower case, words separated by one space: layout, case and punctuation do not hide a leak."""
    return " ".join(WORD.findall(text.lower()))


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets: with at most ``budget`` edits one is untouched."""
    n = budget + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    masks: dict[str, int] = field(default_factory=dict)


def myers(item: Item, text: str, begin: int, end: int) -> tuple[int, int]:
    """Smallest edit distance of the item to any stretch of text[begin:end], and where that stretch ends.

    One column of the dynamic program per character, as bit vectors over the item's characters.
    """
    m = len(item.text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, best_end = m, begin
    masks = item.masks
    for j in range(begin, end):
        eq = masks.get(text[j], 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, best_end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = (mh | ~(xv | ph)) & full
        down = ph & xv
    return best, best_end


class Matcher:
    """Finds items in texts: all pieces in one automaton, then a check around each diagonal that was hit."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: list[Item] = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalize(text or "")
            if not text:
                continue
            budget = int(rate * len(text)) if len(text) >= SHORT_CHARS else 0
            item = Item(item_id, text, budget)
            for i, c in enumerate(text):
                item.masks[c] = item.masks.get(c, 0) | 1 << i
            for at, piece in pieces(text, budget):
                hits.setdefault(piece, []).append((len(self.items), at))
            self.items.append(item)
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        if hits:
            self.automaton.make_automaton()

    def matches(self, document: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop), the best stretch per item; positions in the normalised text.

        ``start`` is where the checked stretch may begin at the earliest, ``stop`` where the best one ends.
        """
        text = normalize(document)
        if not self.items or not text:
            return []
        diagonals: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                diagonals.setdefault(k, set()).add(last - size + 1 - at)
        found = []
        for k, starts in diagonals.items():
            item = self.items[k]
            n, budget = len(item.text), item.budget
            if len(item.text) < SHORT_CHARS:
                ends = [d for d in sorted(starts) if (d == 0 or text[d - 1] == " ")
                        and (d + n == len(text) or text[d + n] == " ")]
                if ends:
                    found.append((item.item_id, 0, ends[0], ends[0] + n))
                continue
            best = None
            windows: list[list[int]] = []
            for d in sorted(starts):
                a, b = max(0, d - budget), min(len(text), d + n + budget)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            for a, b in windows:
                distance, stop = myers(item, text, a, b)
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, max(a, stop - n - budget), stop)
                    if not distance:
                        break
            if best:
                found.append((item.item_id, *best))
        return sorted(found, key=lambda m: (m[0] is None, m[0] or 0, m[1:]))


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed: the driver holds one partition and one block of about ``chars``."""
    rows = items.select("item_id", "item").where("item IS NOT NULL").dropDuplicates()
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["item"]))
        size += len(r["item"])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(document: Column | str, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> Column:
    """The items of one block that a filing's text contains: an array of structs, best stretch per item.

    An item of n characters may differ by int(rate * n) edits (insertions, deletions, substitutions) after
    normalisation. It is cut into one piece more than that, so some piece must occur exactly: an Aho-Corasick automaton
    over all pieces finds these in one pass, and Myers' bit-parallel distance decides around each. Texts are read
    whole. NULL and empty documents contain nothing; NULL and empty items are contained nowhere; items of fewer than
    SHORT_CHARS characters must occur exactly, as whole words.
    """
    key = key_of("items", items, rate)
    kind = to_arrow_type(MATCHES)

    @F.arrow_udf(MATCHES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = held(key, lambda: Matcher(items, rate))
        names = MATCHES.elementType.names
        for batch in batches:
            yield pa.array([[dict(zip(names, m)) for m in matcher.matches(t.as_py() or "")] for t in batch],
                           type=kind)
    return run(document)


def contaminated(filings: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(filing_id, item_id, distance, start, stop): one row per filing and item that it contains.

    Items go in blocks of bounded size, each a pass over all filings with the block in the tasks' closure. A repeated
    filing gives repeated rows; equal items with different ids each give theirs; other columns are not read.
    """
    def part(block):
        # explode_outer: before a plain explode the optimiser asks for the array's size, matching everything twice
        return (filings.select("filing_id", leaks("document", block, rate).alias("_m"))
                .select("filing_id", F.explode_outer("_m").alias("_m")).where("_m IS NOT NULL")
                .select("filing_id", "_m.*"))

    found, blocks = None, item_blocks(items)
    block, following = next(blocks, []), next(blocks, None)
    while following is not None:  # one of several: its matches are written, so the driver lets go of the block
        done = materialize(part(block))
        found = done if found is None else found.union(done)
        block, following = following, next(blocks, None)
    return part(block) if found is None else found.union(part(block))


def without_leaks(filings: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Filings, with all their columns, that contain no item."""
    blocks = item_blocks(items)
    block, following = next(blocks, []), next(blocks, None)
    while following is not None:
        filings = materialize(filings.where(F.size(leaks("document", block, rate)) == 0))
        block, following = following, next(blocks, None)
    return filings.where(F.size(leaks("document", block, rate)) == 0)
