"""Peers of securities: the largest inner products of factor exposures, by collision-counting hashing.

Records: securities (``security_id``, ``exposures``). Vectors stand in blocks. In a block every vector gets one more
component that makes all norms equal, so that the largest inner product with a question is the smallest distance to it.
For each of many random directions the block's projections are sorted; a window around the question's own projection is
widened step by step (the window of a larger radius holds that of a smaller one, so only what is new is read), and a
vector that falls into enough of the windows is verified by its inner product.

How wide the windows get follows from the distance D of the k-th best vector known so far. The difference of two
projections is normal with their distance as deviation, so a vector no farther than D lies in a window of half-width
``REACH`` * D with known probability; the collision threshold is ``SLACK`` deviations under the expected count.
"""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import materialize
from .exposures import all_present, common_width, finite
from .words import likely_first

DIRECTIONS = 96
REACH = 1.1
SLACK = 1.6
GROWTH = 1.5
FEW = 0.04                # windows with a larger share of a block's places are counted by place
BLOCK_ROWS = 8_192        # vectors of a block, about; their positions fit 16 bits
ASKED_ROWS = 512          # questions of a block, about
SAMPLE_ROWS = 2_048       # vectors of the sample that gives every question a first bound; results do not depend on it
MOST_TASKS = 20_000
SEED = 71


def threshold() -> int:
    p = math.erf(REACH / math.sqrt(2))
    return max(1, math.ceil(DIRECTIONS * p - SLACK * math.sqrt(DIRECTIONS * p * (1 - p))))


def products(vectors: np.ndarray, question: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, so that equal vectors get equal sums."""
    total = np.zeros(len(vectors))
    for j, x in enumerate(question):
        total += vectors[:, j] * x
    return total


class CollisionIndex:
    """The sorted projections of one block. Rows stand in the order that decides ties."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.norm = math.sqrt(squares.max())
        self.lines = np.random.default_rng(SEED).standard_normal((DIRECTIONS, vectors.shape[1] + 1))
        spare = np.sqrt(np.maximum(0.0, self.norm ** 2 - squares))
        at = self.lines @ (np.column_stack([vectors, spare]) / self.norm).T
        order = np.argsort(at, axis=1, kind="stable")
        self.order = order.astype(np.uint16)
        self.rank = np.empty_like(self.order)  # where each vector stands in each direction
        np.put_along_axis(self.rank, order, np.arange(len(vectors), dtype=np.uint16)[None, :], axis=1)
        # all directions in one ascending array: each is moved behind the one before it
        self.most = float(np.abs(at).max()) + 1.0
        self.shift = np.arange(DIRECTIONS) * 4 * self.most
        self.flat = (np.take_along_axis(at, order, axis=1) + self.shift[:, None]).reshape(-1)
        self.least = threshold()

    def places(self, targets: np.ndarray, side: str) -> np.ndarray:
        """Where each direction's target stands among its projections."""
        found = np.searchsorted(self.flat, np.clip(targets, -self.most, self.most) + self.shift, side)
        return found - np.arange(DIRECTIONS) * len(self.vectors)

    def inside(self, low: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Per vector the number of windows that hold it, from its places in the sorted projections."""
        # places before a window wrap around to large numbers
        held = self.rank - low.astype(np.uint16)[:, None] < width.astype(np.uint16)[:, None]
        return np.add.reduce(held.view(np.uint8), axis=0, dtype=np.uint8)

    def nearest(self, question: np.ndarray, bound: float, own: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the k best verified vectors, all of them if there are fewer.

        ``bound``: an inner product that k vectors of the whole table reach (minus infinity if unknown); a block none of
        whose vectors is long enough to reach it has none. ``own``: rows left out.
        """
        n, length = len(self.vectors), math.sqrt(question @ question)
        reach = length * self.norm
        wanted = 0 if bound > reach * (1 + 1e-9) else min(k, n - len(own))
        rows, scores = np.empty(0, np.int64), np.empty(0)
        if not wanted:
            return rows, scores
        line = self.lines[:, :-1] @ (question / length)
        counts, seen = np.zeros(n, np.uint8), np.zeros(n, bool)
        seen[own] = True

        def widest(product: float) -> float:  # distances are in units of the block's longest vector
            return REACH * math.sqrt(max(0.0, 2 - 2 * max(-1.0, product / reach))) + 1e-9

        half = widest(bound) if bound > -math.inf else REACH
        low = high = None
        while True:
            new_low, new_high = self.places(line - half, "left"), self.places(line + half, "right")
            width = new_high - new_low
            if width.sum() > FEW * len(self.flat):
                counts = self.inside(new_low, width)
            else:  # narrow windows: only what is new in them is read
                old = (new_low, new_low) if low is None else (low, high)
                fresh = [o[x] for o, a, b, c, d in zip(self.order, new_low, *old, new_high, strict=True)
                         for x in (slice(a, b), slice(c, d))]
                counts = counts + np.bincount(np.concatenate(fresh), minlength=n).astype(np.uint8)
            low, high = new_low, new_high
            found = np.flatnonzero((counts >= self.least) & ~seen)
            seen[found] = True
            near = self.vectors[found]
            if len(found) > k:  # a quick product first; only what may be among the k best is added up exactly
                quick = near @ question
                best = quick >= np.partition(quick, len(found) - k)[len(found) - k] - 1e-9 * reach
                found, near = found[best], near[best]
            rows = np.concatenate([rows, found])
            scores = np.concatenate([scores, products(near, question)])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) < wanted:
                half *= GROWTH
            elif len(rows) < k or half >= (needed := widest(max(bound, scores[-1]))):
                return rows, scores
            else:
                half = min(half * GROWTH, needed)


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _in_blocks(rows: DataFrame, count: int, size: int, bounds: str, pack) -> DataFrame:
    """One row per partition of about ``size`` rows, written: ``pack(ids, vectors)`` gives further columns.

    Partitions are filled in turn, so no key decides where a row goes.
    """
    ids = rows.schema["security_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        names, vectors = whole.column(0).combine_chunks(), whole.column(1).combine_chunks()
        width = len(vectors[0])
        values = _matrix(vectors, width)
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([values.tobytes()]),
             *pack(names, values)], names=["ids", "vectors", *(["bounds"] if bounds else [])])

    ordered = (rows.select("security_id", "exposures").repartition(max(1, math.ceil(count / size)))
               .sortWithinPartitions(F.col("security_id").isNull(), "security_id", "exposures"))
    return materialize(ordered.mapInArrow(run, f"ids array<{ids}>, vectors binary{bounds}")
                       .withColumn("block", F.spark_partition_id()))


def _positions(names: pa.Array) -> dict[object, list[int]]:
    found = defaultdict(list)
    for i, name in enumerate(names.to_pylist()):
        found[name].append(i)
    return found


def nearest_peers(securities: DataFrame, asked: Column, k: int = 20) -> DataFrame:
    """(question, security_id, rank, peer_id, product): the k largest inner products found for every asked row.

    ``asked`` is a condition on the columns of ``securities``; every row for which it holds is a question, and the rows
    of all other ids are its candidates. Nearest come first, ties to the smaller id (NULL last); with fewer than k
    candidates all are returned. ``product`` is the inner product of the original vectors in double precision.

    Vectors that are NULL, empty, hold NULL or non-finite components, have a squared length of zero or beyond double
    precision, or another length than most vectors, take no part. A row without id can be a peer, not a question.
    Repeated rows are candidates each and questions each. An empty table gives no rows. Other columns are only read by
    ``asked``.

    Blocks of vectors meet blocks of questions by an equality join on block numbers; a task holds one of each. A sample
    of SAMPLE_ROWS vectors, the only data in every task, gives questions a first bound; every vector is indexed.
    """
    square = F.aggregate("exposures", F.lit(0.0), lambda a, x: a + x * x)
    rows = securities.select("security_id", finite("exposures").alias("exposures"),
                             (F.coalesce(asked, F.lit(False)) & F.col("security_id").isNotNull()).alias("asked"))
    whole = materialize(rows.where(all_present("exposures")).where((square > 0) & (square < float("inf"))))
    width = common_width(whole, "exposures")
    vectors = whole.where(F.size("exposures") == width)
    n, n_asked = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0))).first()
    mark = F.xxhash64("security_id", "exposures")
    sample = (vectors.withColumn("mark", mark).where(likely_first("mark", SAMPLE_ROWS, n)).orderBy("mark")
              .limit(SAMPLE_ROWS).select("security_id", "exposures").collect())
    known = np.array([r["exposures"] for r in sample]).reshape(len(sample), width)
    places = defaultdict(list)
    for i, r in enumerate(sample):
        places[r["security_id"]].append(i)

    def first_bounds(names: pa.Array, questions: np.ndarray) -> list[pa.Array]:
        """The k-th largest product within the sample, a little lowered for rounding."""
        if len(known) <= k:
            return [pa.array([np.full(len(questions), -np.inf).tobytes()])]
        found = questions @ known.T
        for i, name in enumerate(names.to_pylist()):
            found[i, places.get(name, [])] = -np.inf
        kth = np.partition(found, len(known) - k, axis=1)[:, len(known) - k]
        lengths = np.sqrt(np.einsum("ij,ij->i", questions, questions))
        return [pa.array([(kth - 1e-9 * (np.abs(kth) + lengths)).tobytes()])]

    blocks = _in_blocks(vectors, n, BLOCK_ROWS, "", lambda names, values: [])
    questions = _in_blocks(vectors.where("asked"), n_asked, ASKED_ROWS, ", bounds binary", first_bounds)
    n_blocks, n_groups = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(n_asked / ASKED_ROWS))
    # few blocks are given to several tasks, each with a part of the questions
    copies = min(n_groups, max(1, math.ceil(4 * securities.sparkSession.sparkContext.defaultParallelism / n_blocks)))
    tasks = min(MOST_TASKS, 3 * n_blocks * copies)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(tasks, "block", "copy")
    right = (questions.select(F.col("ids").alias("asked"), F.col("vectors").alias("questions"), "bounds",
                              F.col("block").alias("group"), (F.col("block") % copies).alias("copy"))
             .withColumn("block", every).repartition(tasks, "block", "copy"))
    ids = rows.schema["security_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index = held = None
        for batch in batches:
            for i in range(batch.num_rows):
                block, names, values, group, asked_names, asked_values, bounds = (c[i] for c in batch.columns)
                if at != block.as_py():
                    at, held = block.as_py(), _positions(names.values)
                    index = CollisionIndex(np.frombuffer(values.as_buffer()).reshape(-1, width).copy())
                asked_vectors = np.frombuffer(asked_values.as_buffer()).reshape(-1, width)
                asked_bounds = np.frombuffer(bounds.as_buffer())
                found, counts = [], []
                for name, question, bound in zip(asked_names.as_py(), asked_vectors, asked_bounds, strict=True):
                    found.append(index.nearest(question, bound, held.get(name, []), k))
                    counts.append(len(found[-1][0]))
                which = np.repeat(np.arange(len(counts)), counts)
                peers = np.concatenate([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which + (group.as_py() << 20)), asked_names.values.take(pa.array(which)),
                     names.values.take(pa.array(peers)), pa.array(np.concatenate([f[1] for f in found]))],
                    names=["question", "security_id", "peer_id", "product"])

    found = (left.join(right, ["block", "copy"])
             .select("block", "ids", "vectors", "group", "asked", "questions", "bounds")
             .mapInArrow(run, f"question bigint, security_id {ids}, peer_id {ids}, product double"))
    best = Window.partitionBy("question").orderBy(F.desc("product"), F.col("peer_id").isNull(), "peer_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("question", "security_id", "rank", "peer_id", "product"))
