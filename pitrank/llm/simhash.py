"""SimHash near-duplicates of filing documents, found with pivot distance tables.

Records: filing documents (``filing_id``, ``document``), one row per filing.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import materialize
from .components import component_roots
from .kinds import LONG
from .words import mix, words_of

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
PIVOTS = 16
LANES = 5            # disjoint bit ranges; with up to MAX_BITS differences, LANES - MAX_BITS of them are equal
BLOCK = 2048         # fingerprints of a cell compared in one task; larger cells are compared block by block

_rng = np.random.default_rng(20_240_601)
PIVOT = _rng.integers(0, 2**64, PIVOTS, dtype=np.uint64)
_edges = [64 * i // LANES for i in range(LANES + 1)]
MASK = np.array([(1 << b) - (1 << a) for a, b in zip(_edges, _edges[1:])], dtype=np.uint64)
_TABLES = list(combinations(range(LANES), LANES - MAX_BITS))
_WEIGHT = _rng.integers(1, 2**63, (PIVOTS, LANES), dtype=np.uint64) | np.uint64(1)


def fingerprint_of(text: bytes) -> int:
    return fingerprint_of_words(words_of(text.lower()))  # of bytes, lower() changes A-Z only


def fingerprint_of_words(words: list[bytes]) -> int:
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        begin = [0, *ends[:-SHINGLE_WORDS].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(begin, (ends[SHINGLE_WORDS - 1:] - 1).tolist())]
    return majority_bits(np.array(hashes, dtype=np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in more than half of the values, in pieces so that long texts need no large matrix."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i:i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(LONG)
def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        prints = [fingerprint_of(t) if t else 0 for t in batch.cast(pa.binary()).to_pylist()]
        yield pa.array(np.array(prints, dtype=np.uint64).view(np.int64))


def fingerprint(document: Column | str) -> Column:
    """64-bit SimHash of a document's 3-word shingles as a signed long; 0 for NULL and texts without words."""
    return _fingerprint(document)


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint within each lane: (n, PIVOTS, LANES)."""
    out = np.empty((len(prints), PIVOTS, LANES), dtype=np.uint8)
    for p in range(PIVOTS):
        for k in range(LANES):
            out[:, p, k] = np.bitwise_count((prints ^ PIVOT[p]) & MASK[k])
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once per choice of lanes, with the pivot coordinates of those lanes folded to one key."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        lane = (pivot_distances(prints).astype(np.uint64) * _WEIGHT).sum(axis=1, dtype=np.uint64)
        keys = [mix(sum((mix(lane[:, k] + np.uint64(k)) for k in table), np.zeros(len(prints), np.uint64))
                    + np.uint64(1 + t)) for t, table in enumerate(_TABLES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                          pa.array(np.tile(prints, len(keys)).view(np.int64))], names=["cell", "print"])


def near_pairs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints at MAX_BITS or fewer differing bits.

    Sorted by the distance to the first pivot, a fingerprint can only meet those whose distance is at most MAX_BITS
    more; of these, pairs whose largest coordinate difference exceeds MAX_BITS are discarded, and the rest are compared.
    """
    table = pivot_distances(prints).sum(axis=2, dtype=np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, prints = table[order], prints[order]
    stop = np.searchsorted(table[:, 0], table[:, 0] + MAX_BITS, side="right")
    left, right = [], []
    step = max(1, 2_000_000 // max(1, len(prints)))
    for i in range(0, len(prints), step):
        j = min(len(prints), i + step)
        counts = stop[i:j] - np.arange(i, j) - 1
        a = np.repeat(np.arange(i, j), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        for p in range(1, PIVOTS):
            if not len(a):
                break
            near = np.abs(table[a, p] - table[b, p]) <= MAX_BITS
            a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= MAX_BITS
        left.append(order[a[near]])
        right.append(order[b[near]])
    return np.concatenate(left), np.concatenate(right)


def spanning_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint connected to another, a link to the first of its component; at most n - 1 links."""
    a, b = near_pairs(prints)
    root = np.arange(len(prints))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cell, i, j); each run of equal keys is one comparison."""
    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        pairs = [spanning_links(np.unique(p)) for p in np.split(prints, cuts) if len(p) > 1]
        a, b = (np.concatenate([x[k] for x in pairs] or [np.empty(0, np.uint64)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    keys, prints = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        keys = np.concatenate([keys, np.stack(cols[:3], axis=1).astype(np.int64)])
        prints = np.concatenate([prints, cols[3].view(np.uint64)])
        # the last run may go on in the next batch
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield out(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield out(keys, prints)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column ``fingerprint``, distinct) within MAX_BITS bits.

    A pair within MAX_BITS agrees wholly in LANES - MAX_BITS lanes, so there all its pivot coordinates are equal: each
    fingerprint is put into one cell per choice of lanes, keyed by those coordinates, and no pair is lost. Inside cells
    the pivot tables over whole fingerprints discard pairs, and survivors are verified. Cells with one fingerprint go
    at once; cells over BLOCK are compared in pairs of blocks, each in a task of its own. Only a spanning set of links
    leaves a task.
    """
    cells = prints.select("fingerprint").mapInArrow(_cells, "cell bigint, print bigint")
    # only the numbers in a cell are counted over all; partial counts keep crowded cells from one task
    crowded = cells.groupBy("cell").agg(F.count("*").alias("_n")).where("_n > 1")
    tasks = (cells.join(crowded, "cell")
             .withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
             .withColumn("_own", F.pmod(F.xxhash64("print"), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
             .select("cell", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "print"))
    # few rows, much work for each: a stated number of partitions is not merged by size
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (tasks.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
            .mapInArrow(_links, "a bigint, b bigint"))


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """(node, root) of all fingerprints (column ``fingerprint``, distinct) that have a link; chained ones share a root."""
    return materialize(component_roots(fingerprint_links(prints)))


def near_duplicates(filings: DataFrame) -> DataFrame:
    """(filing_id, fingerprint, component_id): one row per row of the input.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest ``filing_id`` of all filings that a
    chain of links reaches. Copies share a fingerprint and enter the search as one. NULL and empty documents have
    fingerprint zero and are linked like any other; a NULL id stays and never names a component unless no member has
    an id. Repeated rows are repeated in the result. Other columns are not read; an empty table gives an empty one.
    """
    prints = materialize(filings.select("filing_id", fingerprint("document").alias("fingerprint")))
    distinct = prints.groupBy("fingerprint").agg(F.min("filing_id").alias("_least"))
    roots = fingerprint_groups(distinct)
    # fingerprints without a link are their own component and are not in roots
    named = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("_root"), "_least")
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    members = named.join(least, "_root").select("fingerprint", "component_id")
    return prints.join(members, "fingerprint").select(
        "filing_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
