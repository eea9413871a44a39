"""Groups of texts that share most of their word shingles, by SimHash pivots, MinHash cells and exact similarity.

Records: filing documents (``filing_id``, ``document``).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import materialize
from ..sources.landed import settings
from .components import component_roots
from .simhash import fingerprint_groups, fingerprint_of_words
from .words import WordHashes, mix, words_of
from .worker import held, key_of

CHUNK_SHINGLES = 2_000_000   # shingles, 8 bytes each, of the texts that one comparison holds
# Whole texts and sets go to workers in small batches. Before texts are shuffled to find those that have candidates, most
# others are dropped by a Bloom filter on their ids.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
            "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "67108864"}
ID_BITS = 8                  # bits of the filter for each id: 2 % of the other texts pass it
FILTER_BITS = 1 << 16, 1 << 26
BLOCK = 512                  # texts of a cell that is part of a larger group; its cells are compared block by block


@dataclass(frozen=True)
class Similar:
    """Texts are linked when the Jaccard similarity of their sets of ``words``-word shingles is ``least`` or more.

    Texts whose SimHash fingerprints are linked are always compared. Any other pair of similarity s meets in a MinHash cell
    with probability 1 - (1 - s ** rows) ** bands: 0.99978 at 0.8, more above.
    """
    words: int = 5
    least: float = 0.8
    bands: int = 16
    rows: int = 4
    seed: int = 23


def normal(document: bytes) -> list[bytes]:
    return words_of(document.lower())  # of bytes, lower() changes A-Z only


def body_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words, sorted; a shorter text is one run, a text without words none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for k in range(min(width, len(words))):
        out = mix(mix(out) + h[k:k + n])
    return np.unique(out)


class Sketcher:
    def __init__(self, p: Similar):
        r = np.random.default_rng(p.seed)
        n = p.bands * p.rows
        self.p, self.hashes = p, WordHashes()
        self.times = r.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
        self.plus = r.integers(0, 2**64, n, dtype=np.uint64)

    def sketch(self, text: bytes) -> np.ndarray:
        """The text's own hash, the number of its shingles, its SimHash, then one cell key per band (none without words)."""
        words = normal(text)
        shingles = shingle_set(words, self.p.words, self.hashes)
        body = np.array([body_of(words), len(shingles), fingerprint_of_words(words)], np.uint64)
        if not len(shingles):
            return body
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 4096):  # long texts in pieces
            least = np.minimum(least, mix(shingles[None, i:i + 4096] * self.times[:, None] + self.plus[:, None]).min(axis=1))
        cells = np.arange(1, self.p.bands + 1, dtype=np.uint64)
        for column in least.reshape(self.p.bands, self.p.rows).T:
            cells = mix(mix(cells) + column)
        return np.concatenate([body, cells])


def sketch(document: Column | str, p: Similar = Similar()) -> Column:
    """Array of longs: the hash of the lower-cased words, the number of shingles, the SimHash fingerprint, the text's cells;
    NULL has no words."""
    key = key_of("sketch", p)

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sketcher = held(key, lambda: Sketcher(p))
        for batch in batches:
            yield pa.array([sketcher.sketch(t.as_py() or b"").view(np.int64) for t in batch.cast(pa.binary())],
                           pa.list_(pa.int64()))
    return run(document)


def mark(filing_id: Column | str, document: Column | str) -> Column:
    """Tells rows of different ids or texts apart; NULL is a value."""
    return F.xxhash64(filing_id, document)


def _sets(document: Column | str, p: Similar) -> Column:
    """A text's whole shingle set."""
    key = key_of("shingles", p)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = held(key, WordHashes)
        for batch in batches:  # one text's words at a time
            yield pa.array([shingle_set(normal(t.as_py() or b""), p.words, hashes).tobytes() for t in batch.cast(pa.binary())],
                           pa.binary())
    return run(document)


def classes(sets: list[np.ndarray], cells: list[np.ndarray], least: float) -> np.ndarray:
    """For each text the number of its class: texts that share a cell are compared, by whole sets, unless they are
    connected already."""
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    root, marked = np.arange(len(sets)), np.zeros(tokens.max() + 1, bool)
    keys, row = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    order = np.lexsort((row, keys))
    for members in np.split(row[order], np.flatnonzero(np.diff(keys[order])) + 1):
        for at, i in enumerate(members):
            others = members[at + 1:]
            others = others[root[others] != root[i]]
            if not len(others):
                if (root[members] == root[i]).all():
                    break
                continue
            own = tokens[starts[i]:starts[i] + sizes[i]]
            marked[own] = True
            ends = np.cumsum(sizes[others])
            firsts = ends - sizes[others]
            inside = np.arange(ends[-1]) + np.repeat(starts[others] - firsts, sizes[others])
            both = np.add.reduceat(marked[tokens[inside]].astype(np.int64), firsts)
            marked[own] = False
            near = others[both >= least * (sizes[others] + sizes[i] - both) - 1e-9]
            for old in np.unique(root[near]):
                root[root == old] = root[i]
    return root


def _classes_of_chunks(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; each run of one group is one comparison. Repeated rows of a body count once."""
        group, members = None, {}

        def out() -> pa.RecordBatch:
            bodies = np.array(list(members), np.int64)
            root = classes([s for s, _ in members.values()], [c for _, c in members.values()], least)
            first = np.full(len(bodies), np.iinfo(np.int64).max)
            np.minimum.at(first, root, bodies)
            return pa.RecordBatch.from_arrays([pa.array(bodies), pa.array(first[root])], names=["node", "root"])

        for batch in batches:
            for of, body, cells, shingles in zip(*batch.columns, strict=True):
                if of.as_py() != group:
                    if members:
                        yield out()
                    group, members = of.as_py(), {}
                if body.as_py() not in members:
                    members[body.as_py()] = (np.frombuffer(shingles.as_py(), np.uint64), np.array(cells.as_py(), np.int64))
        if members:
            yield out()
    return run


def spanning_links(bodies: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the texts whose similarity is ``least`` or more; at most n - 1.

    A text is compared with all texts that it is not yet connected to.
    """
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    root = np.arange(len(sets))
    left, right = [], []
    held = np.zeros(tokens.max() + 1, bool)
    for i in range(len(sets)):
        if (root == root[i]).all():
            break
        own = tokens[starts[i]:starts[i] + sizes[i]]
        held[own] = True
        both = np.add.reduceat(held[tokens].astype(np.int64), starts)
        held[own] = False
        near = (both >= least * (sizes + sizes[i] - both) - 1e-9) & (root != root[i])
        for other in np.unique(root[near]):
            j = np.flatnonzero(near & (root == other))[0]
            left.append(bodies[i])
            right.append(bodies[j])
            root[root == other] = root[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, i, j); each run of equal keys is one comparison."""
        key, members = None, {}

        def out() -> pa.RecordBatch:
            a, b = spanning_links(np.array(list(members), np.int64), list(members.values()), least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)))
            for (*k, text), s in zip(keys, batch.column(4)):
                if k != key:
                    if len(members) > 1:
                        yield out()
                    key, members = k, {}
                members[text] = np.frombuffer(s.as_py(), np.uint64)
        if len(members) > 1:
            yield out()
    return run


def filter_for(n: int) -> dict[str, str]:
    """Settings for a Bloom filter of ``n`` ids. The driver sends it with every task set that reads texts and holds several
    copies meanwhile, so it is no larger than its ids need; beyond eight million ids more texts pass."""
    least, most = FILTER_BITS
    return {"spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": str(max(1, n)),
            "spark.sql.optimizer.runtime.bloomFilter.numBits": str(min(most, max(least, ID_BITS * n)))}


def _whole_sets(filings: DataFrame, wanted: DataFrame, p: Similar) -> DataFrame:
    """(body, shingles) of the rows named by ``wanted`` (mark, body, n_rows).

    Rows are found by a hash of id and text that Spark computes, so no other text goes to Python.
    """
    texts = filings.select(mark("filing_id", "document").alias("_mark"), "document")
    wanted = wanted.where("n_rows >= 1")  # always so: a filter on that side is what makes Spark build the Bloom filter
    return texts.join(wanted, F.col("_mark") == F.col("mark")).select("body", _sets("document", p).alias("shingles"))


def fingerprint_cells(sketches: DataFrame) -> DataFrame:
    """(body, n_shingles, cell): a cell for the texts of every group of linked fingerprints, found by ``simhash``.

    Fingerprints group by the pivot tables and exact distances of the near-duplicate operator; texts of equal
    fingerprints are in one cell too.
    """
    texts = sketches.where(F.size("sketch") > 3).select(
        F.get("sketch", F.lit(0)).alias("body"), F.get("sketch", F.lit(1)).alias("n_shingles"),
        F.get("sketch", F.lit(2)).alias("fingerprint")).distinct()
    roots = fingerprint_groups(texts.select("fingerprint").distinct())
    return texts.join(roots, texts.fingerprint == roots.node, "left").select(
        "body", "n_shingles", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fingerprint")).alias("cell"))


def similar_roots(filings: DataFrame, sketches: DataFrame, p: Similar) -> DataFrame:
    """(node, root) of all bodies that share a cell with another: bodies with equal root are connected by similar texts.

    Texts that share a cell, of linked SimHash fingerprints or of MinHash values, are candidates; texts connected by cells
    form a group, found from ids alone. Every text's shingle set is then sent once, to its group's comparison. Groups of
    more than CHUNK_SHINGLES shingles are compared cell by cell, and cells over BLOCK texts in pairs of blocks; these leave
    links whose components are taken.
    """
    cells = materialize(sketches.where(F.size("sketch") > 3).select(
        F.get("sketch", F.lit(0)).alias("body"), F.get("sketch", F.lit(1)).alias("n_shingles"),
        F.explode(F.slice("sketch", 4, p.bands)).alias("cell")).distinct().union(fingerprint_cells(sketches)))
    crowded = (cells.groupBy("cell").agg(F.count("*").alias("_n"), F.min("body").alias("_first"),
                                         F.sum(F.xxhash64("body") % (1 << 40)).alias("_s"),
                                         F.bit_xor(F.xxhash64("body")).alias("_x")).where("_n > 1")
               .groupBy("_n", "_s", "_x").agg(F.min(F.struct("cell", "_first")).alias("_c")).select("_n", "_c.*"))
    members = materialize(cells.join(crowded, "cell").select("cell", "_n", "_first", "body", "n_shingles"))
    groups = component_roots(members.select(F.col("body").alias("a"), F.col("_first").alias("b")))
    own = (members.groupBy("body").agg(F.max("n_shingles").alias("n_shingles"), F.collect_set("cell").alias("cells"))
           .join(groups.select(F.col("node").alias("body"), F.col("root").alias("group")), "body"))
    own = materialize(own)
    large = materialize(own.groupBy("group").agg(F.sum("n_shingles").alias("_size")).where(F.col("_size") > CHUNK_SHINGLES))
    # one row of each body; one without id only where all are
    wanted = materialize(sketches.select("filing_id", "mark", F.get("sketch", F.lit(0)).alias("body"))
                         .join(own.select("body"), "body").groupBy("body")
                         .agg(F.min(F.struct(F.col("filing_id").isNull(), "filing_id", "mark")).alias("_r"),
                              F.count("*").alias("n_rows")).select("body", "_r.mark", "n_rows"))
    with settings(filings.sparkSession, filter_for(wanted.count())):
        return materialize(_compared(filings, own, large, members, wanted, p))


def _compared(filings: DataFrame, own: DataFrame, large: DataFrame, members: DataFrame, wanted: DataFrame, p: Similar
              ) -> DataFrame:
    sets = _whole_sets(filings, wanted, p)
    parts = int(filings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if large.isEmpty():
        chunked, rest = own, None
    else:
        sets = materialize(sets)
        chunked, rest = own.join(large, "group", "left_anti"), own.join(large, "group", "left_semi")
    found = (chunked.join(sets, "body").select("group", "body", "cells", "shingles")
             .repartition(parts, "group").sortWithinPartitions("group")
             .mapInArrow(_classes_of_chunks(p.least), "node bigint, root bigint"))
    if rest is None:
        return found
    links = _links_by_cell(members.join(rest.select("body"), "body"), sets, p, parts)
    return found.union(component_roots(links))


def _links_by_cell(members: DataFrame, sets: DataFrame, p: Similar, parts: int) -> DataFrame:
    tasks = (members.withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
             .withColumn("_own", F.pmod(F.xxhash64("body"), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
             .select("cell", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "body"))
    return (tasks.join(sets, "body").select("cell", "i", "j", "body", "shingles")
            .repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
            .mapInArrow(_links(p.least), "a bigint, b bigint"))


def _rooted(filings: DataFrame, p: Similar) -> DataFrame:
    """(filing_id, mark, body, root): one row per row."""
    with settings(filings.sparkSession, SETTINGS):
        sketches = materialize(filings.select("filing_id", mark("filing_id", "document").alias("mark"),
                                              sketch("document", p).alias("sketch")))
        roots = similar_roots(filings, sketches, p)
    bodies = sketches.select("filing_id", "mark", F.get("sketch", F.lit(0)).alias("body"))
    return bodies.join(roots, bodies.body == roots.node, "left").select(
        "filing_id", "mark", "body", F.coalesce("root", "body").alias("root"))


def similar_groups(filings: DataFrame, p: Similar = Similar()) -> DataFrame:
    """(filing_id, body, root): one row per row; rows with equal ``root`` are connected by links of similar texts.

    Copies share a body and enter the search as one. NULL, empty and blank texts are one group. Other columns are not
    read; an empty table gives an empty one.
    """
    return _rooted(filings, p).select("filing_id", "body", "root")


def one_of_each_group(filings: DataFrame, p: Similar = Similar()) -> DataFrame:
    """Filings, with all their columns, of which one of every group of similar texts stays.

    It is the one with the smallest id (no id comes last, then the smaller text hash decides), and one row of it. Rows
    are told by id and text together. An empty table stays empty; NULL and blank texts are one group.
    """
    rows = materialize(_rooted(filings, p).groupBy("filing_id", "mark", "body", "root").agg(F.count("*").alias("n")))
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("filing_id").isNull(), "filing_id", "body")).alias("s")).select(
        "root", F.col("s.filing_id").alias("id"), F.col("s.body").alias("first"))
    rows = materialize(rows.join(stays, "root").select(
        "filing_id", "mark", "root", "n",
        (F.col("filing_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("first"))).alias("stays")))
    # whole rows travel as one column, so no name of theirs can be in the way
    named = filings.select(F.struct(*filings.columns).alias("row"), mark("filing_id", "document").alias("text"))

    def among(side: DataFrame, how: str) -> DataFrame:
        side = side.select(F.col("filing_id").alias("id"), "mark", "root")
        return named.join(side, F.col("row.filing_id").eqNullSafe(F.col("id")) & (F.col("text") == F.col("mark")), how)

    repeated = materialize(rows.where("stays").groupBy("root").agg(F.sum("n").alias("_n")).where("_n > 1"))
    if repeated.isEmpty():
        return among(rows.where("NOT stays"), "left_anti").select("row.*")
    once = (among(rows.where("stays").join(repeated, "root"), "inner").groupBy("root")
            .agg(F.min_by("row", F.col("row.document")).alias("row")).select("row.*"))
    going = rows.where("NOT stays").unionByName(rows.where("stays").join(repeated.select("root"), "root", "left_semi"))
    return among(going, "left_anti").select("row.*").union(once)
