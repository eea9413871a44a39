"""Ranked lexical search: which filing documents say most about an item, by integer impacts in norm buckets.

Records: filing documents (``filing_id``, ``document``); the searched ``items`` (``item_id``, ``item``) have no counterpart
among the project's records. A document's vector holds, per term of the items, the term's weight times its impact in the
document; an item's vector holds how often it names a term. Documents are ordered by the length of their vectors and cut
into buckets. Per item and bucket, the product of the lengths (Cauchy-Schwarz) and the bucket's largest value of every
coordinate bound what a document can reach; inside, coordinates are added by falling bound until what is left, by either
bound, cannot lift a document to the item's k-th best score. Survivors are rescored in integers.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import materialize
from .decontaminate import item_blocks
from .words import likely_first

BUCKET_ROWS = 2_048
BUCKET_VALUES = 1 << 20
SAMPLE_ROWS = 1_024       # documents of the sample that gives first thresholds; results do not depend on it
COUNTED = "filing_id {}, at bigint, n bigint, terms array<int>, counts array<int>"
ROUNDING = 1 + 1e-9       # bounds are computed in double precision, scores are integers

# ASCII letters and digits stay, A-Z become a-z, other ASCII characters separate; bytes of other characters stay
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Asked:
    """An item: its terms by falling index, how often it names them, and the length of that vector."""
    number: int
    item_id: object
    terms: np.ndarray
    times: np.ndarray
    length: float


class Asking:
    """A block of items and the terms they use. Only these terms' impacts matter to any of its scores."""

    def __init__(self, items: list[tuple[object, str]]):
        counted = [(item_id, Counter(terms_of((text or "").encode()))) for item_id, text in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
        self.items = []
        for number, (item_id, counts) in enumerate(counted):
            pairs = sorted((self.vocabulary[t], n) for t, n in counts.items())
            if pairs:
                terms, times = np.array(pairs, np.int64).T
                self.items.append(Asked(number, item_id, terms, times, math.sqrt(float((times ** 2).sum()))))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and where each row's begin."""
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets


def _weighted(batch: pa.RecordBatch, weights: np.ndarray, n_documents: int, n_terms: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, values, offsets) of a batch's vectors: weight times impact, all in 64-bit integers."""
    n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
    terms, offsets = _flat(batch.column(batch.schema.get_field_index("terms")))
    tf, _ = _flat(batch.column(batch.schema.get_field_index("counts")))
    m = np.repeat(100 - 75 + (75 * n * n_documents) // n_terms, np.diff(offsets))
    return terms, weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)), offsets


class Bucket:
    """Documents of similar length of vector, by row and by coordinate."""

    def __init__(self, terms: np.ndarray, values: np.ndarray, offsets: np.ndarray, size: int):
        self.terms, self.values, self.offsets = terms, values, offsets
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        by_term = np.argsort(terms, kind="stable")
        self.rows, self.column = rows[by_term], values[by_term].astype(np.float64)
        self.starts = np.searchsorted(terms[by_term], np.arange(size + 1))
        self.largest = np.zeros(size)
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            self.largest[filled] = np.maximum.reduceat(self.column, self.starts[filled])
        self.squares = np.bincount(rows, values.astype(np.float64) ** 2, len(offsets) - 1)
        self.length = math.sqrt(self.squares.max(initial=0.0))

    def survivors(self, item: Asked, least: int) -> np.ndarray:
        """Rows that may score ``least`` or more (with 1 at least)."""
        if item.length * self.length * ROUNDING < least:
            return np.empty(0, np.int64)
        bounds = item.times * self.largest[item.terms]
        order = np.argsort(-bounds, kind="stable")
        left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0)  # what the coordinates from a place on can add
        if left[0] * ROUNDING < least or not left[0]:
            return np.empty(0, np.int64)
        score, square = np.zeros(len(self.squares)), np.zeros(len(self.squares))
        used = 0
        while left[used] * ROUNDING >= least and left[used] > 0:
            t, times = item.terms[order[used]], float(item.times[order[used]])
            at = slice(self.starts[t], self.starts[t + 1])
            score[self.rows[at]] += times * self.column[at]
            square[self.rows[at]] += self.column[at] ** 2
            used += 1
        rest = item.times[order[used:]].astype(np.float64)
        tail = math.sqrt((rest ** 2).sum()) * np.sqrt(np.maximum(0.0, self.squares * ROUNDING - square))
        return np.flatnonzero((score > 0) & ((score + np.minimum(left[used], tail)) * ROUNDING >= least))

    def exact(self, item: Asked, rows: np.ndarray, size: int) -> np.ndarray:
        """Integer scores of some rows over all their coordinates."""
        times = np.zeros(size, np.int64)
        times[item.terms] = item.times
        lengths = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[rows] - (ends - lengths), lengths)
        added = np.concatenate([[0], np.cumsum(times[self.terms[at]] * self.values[at])])
        return added[ends] - added[ends - lengths]


class Best:
    """The k best documents of every item that a task has seen."""

    def __init__(self, asking: Asking, k: int, thresholds: dict[int, int]):
        self.asking, self.k = asking, k
        self.least = {i.number: max(1, thresholds.get(i.number, 1)) for i in asking.items}
        self.found: dict[int, pa.Table] = {}

    def add(self, ids: pa.Array, bucket: Bucket) -> None:
        size = len(self.asking.vocabulary)
        for item in self.asking.items:
            least = self.least[item.number]
            rows = bucket.survivors(item, least)
            scores = bucket.exact(item, rows, size)
            rows, scores = rows[scores >= least], scores[scores >= least]
            if not len(rows):
                continue
            table = pa.table({"score": scores, "filing_id": ids.take(pa.array(rows))})
            if item.number in self.found:
                table = pa.concat_tables([self.found[item.number], table])
            order = pc.sort_indices(table, sort_keys=[("score", "descending"), ("filing_id", "ascending")])
            table = self.found[item.number] = table.take(order[:self.k])
            if len(table) == self.k:
                self.least[item.number] = max(least, table["score"][-1].as_py())

    def rows(self) -> Iterator[pa.RecordBatch]:
        for number, table in self.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(table), number), pa.int32()), table["score"].combine_chunks(),
                 table["filing_id"].combine_chunks()], names=["number", "score", "filing_id"])


def _counted(filings: DataFrame, asking: Asking) -> DataFrame:
    """Per document with a term: number of terms, and counts of those that items use. The one pass over the texts."""
    vocabulary = asking.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                words = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                if not words:
                    continue
                mine = sorted((vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary)
                kept.append(i)
                n.append(len(words))
                terms.append([t for t, _ in mine])
                counts.append([c for _, c in mine])
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(kept, pa.int32())) for c in batch.columns[:2]], pa.array(n, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["filing_id", "at", "n", "terms", "counts"])

    ids = filings.schema["filing_id"].dataType.simpleString()
    rows = filings.select("filing_id", F.monotonically_increasing_id().alias("at"), F.col("document").cast("binary"))
    return materialize(rows.mapInArrow(run, COUNTED.format(ids)))


def _searched(filings: DataFrame, block: list[tuple[object, str]], k: int) -> DataFrame:
    asking = Asking(block)
    counted = _counted(filings, asking)
    n_documents, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(len(asking.vocabulary), np.int64)
    frequent = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for r in frequent.collect():  # a row per term of the block at most
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * r["df"] + 1)))

    def with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values, offsets = _weighted(batch, weights, n_documents, n_terms)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            length = np.sqrt(np.bincount(rows, values.astype(np.float64) ** 2, batch.num_rows))
            yield batch.append_column("length", pa.array(length))

    def search(thresholds: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(asking, k, thresholds)
            for batch in batches:
                terms, values, offsets = _weighted(batch, weights, n_documents, n_terms)
                at = 0
                while at < batch.num_rows:
                    full = int(np.searchsorted(offsets, offsets[at] + BUCKET_VALUES, "right")) - 1
                    to = min(at + BUCKET_ROWS, max(at + 1, full), batch.num_rows)
                    inside = slice(offsets[at], offsets[to])
                    best.add(batch.column(0).slice(at, to - at),
                             Bucket(terms[inside], values[inside], offsets[at:to + 1] - offsets[at], len(weights)))
                    at = to
            yield from best.rows()
        return run

    ids = filings.schema["filing_id"].dataType.simpleString()
    found = f"number int, score bigint, filing_id {ids}"
    order = [F.desc("score"), F.col("filing_id").isNull(), "filing_id"]
    ranked = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    used = counted.where(F.size("terms") > 0)
    sample = (used.where(likely_first("at", SAMPLE_ROWS, n_documents)).select("filing_id", "n", "terms", "counts")
              .mapInArrow(search({}), found).withColumn("rank", ranked).where(F.col("rank") == k))
    thresholds = {r["number"]: r["score"] for r in sample.select("number", "score").collect()}  # a row per item at most
    # equal lengths are many where texts are copied; the row's number parts them
    by_length = (used.mapInArrow(with_length, f"{COUNTED.format(ids)}, length double")
                 .repartitionByRange(F.desc("length"), F.xxhash64("at")).sortWithinPartitions(F.desc("length"))
                 .select("filing_id", "n", "terms", "counts"))
    asked = filings.sparkSession.createDataFrame([(i.number, i.item_id) for i in asking.items] or [(None, None)],
                                                 f"number int, item_id {_type_of(asking)}").where("number IS NOT NULL")
    return (by_length.mapInArrow(search(thresholds), found).withColumn("rank", ranked).where(F.col("rank") <= k)
            .join(F.broadcast(asked), "number").select("item_id", "rank", "filing_id", "score"))


def _type_of(asking: Asking) -> str:
    return "string" if any(isinstance(i.item_id, str) for i in asking.items) else "bigint"


def ranked_filings(filings: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, filing_id, score): the k highest-scoring documents of every item, all with a score if fewer.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. With N documents that
    have a term, L terms in them, n in one document, df documents with a term and tf of its occurrences in one, a term
    weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and an item scores the sum of
    w (10^9 tf div (1000 tf + 8 m)) over its terms, repeats included. Equal scores go by filing_id, NULL last.

    NULL and empty documents have no terms and are not counted; repeated filings are documents of their own. NULL items
    and items without terms find nothing; equal items with the same id count once, with different ids each give theirs.
    Texts are read whole; other columns are not read. No documents or no items give no rows.

    Items go in blocks of bounded size (``item_blocks``), each with one pass over the texts. A task holds one bucket of at
    most BUCKET_ROWS documents and sends k rows per item at most.
    """
    found, blocks = None, item_blocks(items)
    block, following = next(blocks, []), next(blocks, None)
    while following is not None:  # one of several: its rows are written, so the driver lets go of the block
        done = materialize(_searched(filings, block, k))
        found = done if found is None else found.union(done)
        block, following = following, next(blocks, None)
    last = _searched(filings, block, k)
    return last if found is None else found.union(last)
