"""Token ids of filing documents in ORC files: integer run-length encoding, row indexes and Bloom filters on ids.

Records: filing documents (``filing_id``, ``document``), one row per filing.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .kinds import INT, LONG, struct
from .tokens import blocks_of, encoder

TOKEN_FILES = T.StructType([
    T.StructField("filing_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("block", T.IntegerType()), T.StructField("block_start", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
_ARROW = pa.schema([("filing_id", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.int32()),
                    ("block_start", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), False)))])

ORC_OPTIONS = {"orc.bloom.filter.columns": "filing_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "compression": "lz4"}


def _encode_block(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in blocks_of(batch.column(1)):
                values, bounds = encoder(tokenizer).encode(texts)
                n = len(texts)
                ids = np.insert(values.view("<i4"), bounds[1:], end_id)
                ends = bounds[1:] + np.arange(1, n + 1)
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array(ends - starts),
                    pa.array(np.full(n, block, dtype=np.int32)), pa.array(starts + start),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids),
                                             type=_ARROW.field("ids").type)], schema=_ARROW)
                start += int(ends[-1])
                at += n
    return run


def write_token_files(filings: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every document and writes the ids as ORC in ascending order of ``filing_id``.

    Filings are range-partitioned and sorted by id (ties by text, so repeated rows come in a fixed order; NULL ids
    first), then encoded where they lie; the file of a range also holds each document's place inside it
    (``block_start``), so no second shuffle is needed to number tokens. A document is its ids followed by ``end_id``;
    NULL and empty documents are ``end_id`` alone. Other columns are not read. An empty table writes no rows.

    ``ids`` are plain ORC integers (run-length encoded); ``filing_id`` has row indexes and a Bloom filter in each
    stripe, so readers skip stripes and row groups, and Spark reads stripes of one file in parallel.
    """
    ordered = (filings.select("filing_id", "document").repartitionByRange("filing_id")
               .sortWithinPartitions("filing_id", "document"))
    (ordered.mapInArrow(_encode_block(tokenizer, end_id), TOKEN_FILES)
     .write.options(**ORC_OPTIONS).orc(path))


def read_token_files(spark: SparkSession, path: str, filing_ids: Iterable[int] | None = None) -> DataFrame:
    """The files' rows; with ``filing_ids`` only those, pushed down to stripe statistics, row indexes and filters."""
    rows = spark.read.schema(TOKEN_FILES).orc(path)
    return rows if filing_ids is None else rows.where(F.col("filing_id").isin(list(filing_ids)))


def token_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start`` to rows of token files: how many ids all documents before this one hold, across files.

    Offsets of files are one row per file (as many as write tasks), summed in the order of their ranges.
    """
    sizes = files.groupBy("block").agg(F.sum("n_tokens").alias("_n"))
    # one row per written file, whatever the number of documents: a running sum and a broadcast are safe
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (rows.join(F.broadcast(offsets), "block")
            .withColumn("start", F.col("_before") + F.col("block_start")).drop("_before"))


DIGESTS = struct(filing_id=LONG, n_tokens=LONG, block=INT, block_start=LONG, ids_crc32=LONG)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ids = lists.values.to_numpy(zero_copy_only=False).view("<u4")
        at = lists.offsets.to_numpy()
        crc = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])], type=pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DIGESTS.names[:-1]), crc], names=DIGESTS.names)


def token_digests(files: DataFrame) -> DataFrame:
    """The files' rows with ``ids_crc32`` instead of ids: unsigned CRC-32 of them as little-endian 32-bit integers."""
    return files.select("filing_id", "n_tokens", "block", "block_start", "ids").mapInArrow(_digest, DIGESTS)
