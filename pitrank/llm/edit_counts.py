"""Token counts of filing documents that stay right under edits, without encoding the whole document again.

Records: filing documents (``document``) and their amendments: ``edits``, an array of (start, stop, replacement) in
code points, applied one after the other, each to the text the one before left.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.lineage import materialize
from ..sources.landed import settings
from .kinds import INT, LONG, STRING, rows, struct
from .tokens import encoder

LEAF_CHARS = 256
# White space after something else: always a pre-token boundary. A subset of what either regex engine calls white space.
CUT = re.compile(r"(?<=\S)[ \t\r\n]")

EDITS = T.ArrayType(struct(start=INT, stop=INT, replacement=STRING))
# The leaves of a document's tree; sums above them are added up again when it is read.
TREE = struct(leaf_chars=T.ArrayType(INT), leaf_tokens=T.ArrayType(INT))
EDITED = struct(tree=TREE, n_tokens_before=LONG, n_leaves_before=LONG, n_tokens=LONG, n_edits=LONG, n_chars=LONG,
                n_chars_reencoded=LONG)


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Pieces of at least ``size`` characters (the last may be shorter) that end at safe boundaries."""
    leaves, at = [], 0
    while len(text) - at > size:
        m = CUT.search(text, at + size)
        if not m:
            break
        leaves.append(text[at:m.start()])
        at = m.start()
    leaves.append(text[at:])
    return leaves


class TokenTree:
    """A segment tree over the leaves of one document: sums of characters and tokens in each subtree."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        pad = [(0, 0)] * (self.size - len(leaves))
        self.sums = [(0, 0)] * self.size + leaves + pad
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            left = self.sums[2 * node][0]
            node *= 2
            if position - begin >= left:
                begin += left
                node += 1
        return node - self.size, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        self.sums[i] = (chars, tokens)
        while i > 1:
            i //= 2
            self._pull(i)

    def leaves(self) -> list[tuple[int, int]]:
        return [x for x in self.sums[self.size:] if x[0]]


def count_tokens(texts: list[str], tokenizer: str) -> list[int]:
    return np.diff(encoder(tokenizer).encode(texts)[1]).tolist()


def build_trees(texts: list[str], tokenizer: str) -> list[TokenTree]:
    pieces = [cut_leaves(t) for t in texts]
    counts = iter(count_tokens([p for ps in pieces for p in ps], tokenizer))
    return [TokenTree([(len(p), next(counts)) for p in ps]) for ps in pieces]


def apply_edit(text: str, tree: TokenTree, start: int, stop: int, replacement: str,
               tokenizer: str) -> tuple[str, TokenTree, int]:
    """The edited text and its tree, and how many characters were encoded again.

    The touched region is every leaf from the one holding the character before the edit to the one holding the
    character after it: those two characters decide whether the region's ends are still boundaries. All other leaves
    keep their counts. A region that has grown large is cut into leaves of its own.
    """
    n = len(text)
    start = min(max(start, 0), n)
    stop = min(max(stop, start), n)
    if n:
        first, left = tree.leaf_at(max(0, start - 1))
        last, right = tree.leaf_at(min(n - 1, stop))
        right += tree.sums[tree.size + last][0]
    else:
        first = last = left = right = 0
    region = text[left:start] + replacement + text[stop:right]
    edited = text[:left] + region + text[right:]
    if len(region) <= 4 * LEAF_CHARS:
        tree.put(first, len(region), count_tokens([region], tokenizer)[0])
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
    else:
        pieces = cut_leaves(region)
        fresh = list(zip(map(len, pieces), count_tokens(pieces, tokenizer)))
        old = tree.sums[tree.size:]
        tree = TokenTree([x for x in old[:first] + fresh + old[last + 1:] if x[0]] or [(0, 0)])
    return edited, tree, len(region)


def _leaf_arrays(trees: list[TokenTree]) -> list[tuple]:
    return [tuple(map(list, zip(*(t.leaves() or [(0, 0)])))) for t in trees]


def token_trees(document: Column | str, tokenizer: str) -> Column:
    """The token tree of a filing's text, to be stored next to it: a struct of its leaves' characters and tokens.

    NULL and empty texts have one empty leaf. The token count of a text is the sum of ``leaf_tokens``.
    """
    @F.arrow_udf(TREE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            built = []
            for i in range(0, len(batch), 500):
                built += _leaf_arrays(build_trees([t or "" for t in batch.slice(i, 500).to_pylist()], tokenizer))
            yield rows(TREE, built)
    return run(document)


def _with_trees(texts: pa.Array, trees: pa.Array, changes: pa.Array, tokenizer: str):
    """(text, tree, edits) of each row; trees that are not stored are built, many texts at a time."""
    for i in range(0, len(texts), 500):
        block = [t or "" for t in texts.slice(i, 500).to_pylist()]
        kept = [TokenTree(list(zip(x["leaf_chars"], x["leaf_tokens"]))) if x else None
                for x in trees.slice(i, 500).to_pylist()]
        lacking = [k for k, (t, x) in enumerate(zip(block, kept)) if x is None or x.chars != len(t)]
        for k, tree in zip(lacking, build_trees([block[k] for k in lacking], tokenizer)):
            kept[k] = tree
        yield from zip(block, kept, changes.slice(i, 500).to_pylist())


def edited_text(text: str | None, edits: list[dict] | None) -> str:
    """The text after edits, without any counting."""
    text = text or ""
    for e in edits or []:
        a = min(max(e["start"] or 0, 0), len(text))
        text = text[:a] + (e["replacement"] or "") + text[min(max(e["stop"] or 0, a), len(text)):]
    return text


def edited(document: Column | str, tree: Column | str, edits: Column | str, tokenizer: str) -> Column:
    """The tree of a filing after its edits, and counts: a struct.

    ``tree`` is the stored tree of ``document``; where it is NULL or does not fit the text it is built. ``n_tokens_before``
    and ``n_leaves_before`` are of the text as it is, ``n_tokens`` and ``n_chars`` of the edited text; ``n_edits`` were
    applied and ``n_chars_reencoded`` lay in touched regions. Edits
    are applied in the order of the array; positions beyond the text are moved to its end, a stop before the start to
    the start. NULL documents count as empty, NULL edits or replacements as none or empty. Repeated rows give equal
    results, other columns are not looked at, and long texts cost one descent and one path per edit.
    """
    @F.arrow_udf(EDITED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, trees, changes in batches:
            done = []
            for text, kept, edits_of in _with_trees(texts, trees, changes, tokenizer):
                edits_of, again = [e for e in edits_of or [] if e], 0
                before, leaves_before = kept.tokens, len(kept.leaves())
                for e in edits_of:
                    text, kept, n = apply_edit(text, kept, e["start"] or 0, e["stop"] or 0, e["replacement"] or "",
                                               tokenizer)
                    again += n
                chars, tokens = _leaf_arrays([kept])[0]
                done.append(({"leaf_chars": chars, "leaf_tokens": tokens}, before, leaves_before, kept.tokens,
                             len(edits_of), kept.chars, again))
            yield rows(EDITED, done)
    return run(document, tree, edits)


SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}  # whole texts go to workers in these


def with_kept_trees(filings: DataFrame, tokenizer: str) -> DataFrame:
    """(filing_id, document, tree), written to the shared folder: the state that later edits start from.

    Every text is encoded once, here. NULL and empty texts have one empty leaf, repeated rows a tree each; an empty table
    gives an empty one. Other columns are not read.
    """
    with settings(filings.sparkSession, SMALL_BATCHES):
        return materialize(filings.select("filing_id", "document", token_trees("document", tokenizer).alias("tree")))


def edited_filings(kept: DataFrame, edits: Column, tokenizer: str) -> DataFrame:
    """(filing_id, edited): the struct of :func:`edited` for rows with kept trees, which are read, not built."""
    with settings(kept.sparkSession, SMALL_BATCHES):
        return materialize(kept.withColumn("edits", edits)
                           .select("filing_id", edited("document", "tree", "edits", tokenizer).alias("edited")))


LONG_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){6,}")


def redactions_of(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace long numbers by a mark and delete lines equal to an earlier line, last position first.

    From the end to the start, so that no edit moves the positions of those still to come.
    """
    edits = [(m.start(), m.end(), "<number>") for m in LONG_NUMBER.finditer(text)]
    seen, at, gone = set(), 0, []
    for line in text.split("\n"):
        if line.strip():
            if line in seen:
                gone.append((max(0, at - 1), at + len(line), ""))
            seen.add(line)
        at += len(line) + 1
    # numbers inside deleted lines go with them
    i, kept = 0, []
    for e in edits:
        while i < len(gone) and gone[i][1] <= e[0]:
            i += 1
        if i == len(gone) or e[1] <= gone[i][0]:
            kept.append(e)
    return sorted(kept + gone, reverse=True)


@F.arrow_udf(EDITS)
def redactions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The redactions of each document, as edits."""
    kind = to_arrow_type(EDITS)
    for batch in batches:
        yield pa.array([[{"start": a, "stop": b, "replacement": r} for a, b, r in redactions_of(t or "")]
                        for t in batch.to_pylist()], type=kind)
