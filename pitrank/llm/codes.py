"""Product codes of factor exposures: every vector is cut into parts, and a part becomes the index of a codebook entry.

Records: securities (``security_id``, ``exposures``, ``sic_code``). The nearest entry of a part is found by slicing and
intersecting: per coordinate the entries are sorted, and a mask of 64 bits per position says which entries lie before
it. The entries inside an interval are then two masks and an exclusive or; those inside a box are the AND over the
coordinates. An entry outside a box of radius r is farther than r, so a best distance of at most r inside it is exact;
otherwise the box is widened once to that distance.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import materialize
from .exposures import usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK = 16_384       # vectors assigned at a time


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class SlicedBook:
    """The entries of one part, at most 64, prepared for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        bits = np.uint64(1) << np.arange(n, dtype=np.uint64)
        self.sorted, self.before = [], []
        for j in range(width):
            order = np.argsort(entries[:, j], kind="stable")
            self.sorted.append(entries[order, j])
            self.before.append(np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[order])]))
        # half of the entries' typical distance to their neighbour; only the work depends on it
        apart = ((entries[:, None, :] - entries[None, :, :]).astype(np.float64) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.inf)
        near = np.sqrt(apart.min(axis=1))
        near = near[np.isfinite(near)]
        self.radius = max(1, int(np.median(near) / 2)) if len(near) else 1

    def inside(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Per point the mask of the entries within ``radius`` of it in every coordinate."""
        mask = np.full(len(points), ~np.uint64(0))
        for j, (at, before) in enumerate(zip(self.sorted, self.before, strict=True)):
            low = np.searchsorted(at, points[:, j] - radius, "left")
            high = np.searchsorted(at, points[:, j] + radius, "right")
            mask &= before[high] ^ before[low]
        return mask

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every point; the smaller index where entries are equally near."""
        entry, best = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        todo, radius = np.arange(len(points)), np.full(len(points), self.radius, np.int64)
        while len(todo):
            mask = self.inside(points[todo], radius)
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, found = np.nonzero(bits)
            some, starts, counts = np.unique(row, return_index=True, return_counts=True)
            apart = ((points[todo[row]] - self.entries[found]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(apart, starts) if len(starts) else apart
            first = np.where(apart == np.repeat(least, counts), found, ENTRIES)
            first = np.minimum.reduceat(first, starts) if len(starts) else first
            sure = least <= radius[some] ** 2
            entry[todo[some[sure]]], best[todo[some[sure]]] = first[sure], least[sure]
            radius = radius * 2
            radius[some] = np.sqrt(least.astype(np.float64)).astype(np.int64) + 1
            left = np.ones(len(todo), bool)
            left[some[sure]] = False
            todo, radius = todo[left], radius[left]
        return entry, best


class SlicedBooks:
    def __init__(self, codebooks: np.ndarray):
        """``codebooks``: parts x entries x components."""
        self.parts, self.entries, self.size = codebooks.shape
        self.books = [SlicedBook(b) for b in codebooks]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors x parts) entries and the squared distances summed over the parts."""
        codes, error = np.empty((len(vectors), self.parts), np.int64), np.zeros(len(vectors), np.int64)
        for p, book in enumerate(self.books):
            codes[:, p], apart = book.nearest(vectors[:, p * self.size:(p + 1) * self.size])
            error += apart
        return codes, error

    def sums(self, vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and componentwise sum of the parts assigned to each entry."""
        count = np.zeros((self.parts, self.entries), np.int64)
        total = np.zeros((self.parts, self.entries, self.size), np.int64)
        for p in range(self.parts):
            count[p] = np.bincount(codes[:, p], minlength=self.entries)
            np.add.at(total[p], codes[:, p], vectors[:, p * self.size:(p + 1) * self.size])
        return count, total


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            yield piece, matrix(piece, "levels", width)


def _refined(levels: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: entries become the floor of their parts' mean; entries without parts stay.

    A task sends one row per component of the codebooks, whatever the number of its vectors.
    """
    parts, entries, size = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = SlicedBooks(codebooks)
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for _, vectors in _chunks(batches, parts * size):
            n, t = books.sums(vectors, books.assign(vectors)[0])
            count, total = count + n, total + t
        cell = np.flatnonzero(np.repeat(count.reshape(-1), size))
        yield pa.record_batch({"cell": cell, "n": np.repeat(count.reshape(-1), size)[cell], "total": total.reshape(-1)[cell]})

    sums = (levels.select("levels").mapInArrow(run, "cell bigint, n bigint, total bigint")
            .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    flat = codebooks.reshape(-1).copy()
    for r in sums.collect():  # one row per component of a codebook at most
        flat[r["cell"]] = r["total"] // r["n"]
    return flat.reshape(codebooks.shape)


def _levels(exposures: str, scale: int, largest: int):
    """Integer levels floor(scale * x); NULL where a component is NULL, not finite or beyond ``largest``."""
    def level(x):
        scaled = x.cast("double") * scale
        return F.floor(F.when(F.abs(scaled) <= largest, scaled))
    return F.transform(exposures, level)


def exposure_codes(securities: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                   scale: int = SCALE) -> DataFrame:
    """(security_id, code, error, sector_error, codebooks_sha256) of every security with whole exposures.

    Components become the integers floor(scale * x); vectors are cut into ``parts`` equal parts. A part's codebook
    starts as that part of the ``entries`` securities that come first by id (then by vector, NULL ids last); every round
    assigns all parts to their nearest entry and replaces an entry by the floor of its parts' mean. ``code`` has two hex
    digits per part, ``error`` is the squared distance over all parts, ``sector_error`` its sum over a ``sic_code``
    (NULLs together), and the digest is that of all final entries.

    Vectors that are NULL, empty, hold NULL, NaN or infinite components, have another length than most vectors, or hold a
    component whose integer is beyond 2**27 (its squares would not fit) are left out. Repeated rows are coded each; with
    fewer vectors than ``entries`` the codebooks are shorter; an empty table gives no rows. Other columns are not read.
    Codebooks are the only data that the driver and every task hold: ``entries`` times the vector's width.
    """
    if not 1 <= entries <= 64:
        raise ValueError("a mask holds 64 entries")
    rows = securities.select("security_id", "sic_code", _levels("exposures", scale, 2 ** 27).alias("levels"))
    levels, width = usable(rows, "levels")
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    first = levels.orderBy(F.col("security_id").isNull(), "security_id", "levels").limit(entries).collect()
    size = width // parts
    books = np.array([r["levels"] for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _refined(levels, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = SlicedBooks(books) if first else None
        for piece, vectors in _chunks(batches, width):
            codes, error = sliced.assign(vectors)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(text, pa.string()), pa.array(error)],
                                             names=["security_id", "sic_code", "code", "error"])

    ids, sector = rows.schema["security_id"].dataType.simpleString(), rows.schema["sic_code"].dataType.simpleString()
    coded = materialize(levels.mapInArrow(run, f"security_id {ids}, sic_code {sector}, code string, error bigint"))
    # a row per sector: written first, so Spark knows its size; a hot sector's rows stay or are split by adaptive execution
    sums = materialize(coded.groupBy(F.col("sic_code").alias("sector")).agg(F.sum("error").alias("sector_error")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return (coded.join(sums, coded["sic_code"].eqNullSafe(sums["sector"]))
            .select("security_id", "code", "error", "sector_error", F.lit(digest).alias("codebooks_sha256")))
