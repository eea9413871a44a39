"""Sharding records with a permutation-filled lookup table.

Works on any of the library's tables: the return panel by ``security_id``, filing documents by ``filing_id``.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS_PER_SHARD = 128


def key_number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def prime_from(n: int) -> int:
    """The smallest prime that is at least n."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def fill_table(shards: list[str], size: int) -> list[int]:
    """Which shard holds each slot.

    A shard's preference order walks the table from its own offset in its own step; as the size is prime it meets
    every slot. Shards take turns, each claiming the first slot of its order that is free, until none is. The table
    depends on names only, so that adding or removing a shard moves few slots.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if size < len(shards) or prime_from(size) != size:
        raise ValueError("the table size must be a prime of at least the number of shards")
    place = [key_number(f"offset:{s}") % size for s in shards]
    step = [key_number(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, left, turn = [-1] * size, size, 0
    while left:
        while table[place[turn]] >= 0:
            place[turn] = (place[turn] + step[turn]) % size
        table[place[turn]] = turn
        left -= 1
        turn = (turn + 1) % len(shards)
    return table


def slot_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """(slot, shard): ``size`` rows, a number that is set by the caller and does not grow with the data."""
    names = F.lit([shards[i] for i in fill_table(shards, size)])
    return spark.range(1).select(F.posexplode(names).alias("slot", "shard"))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a record: the first 60 bits of its key's MD5, modulo the table size. A NULL key counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(records: DataFrame, shards: list[str], key: str = "security_id", size: int | None = None) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every record.

    The table has a prime number of slots, by default about 128 per shard, so that shares differ by less than one
    percent. It is broadcast (its size is set by the caller), and each record needs one hash and one look-up: no
    record is shuffled, and a crowded source spreads like any other because only the key counts. Equal keys, repeated
    rows and NULL keys stay together. Columns named ``slot`` or ``shard`` are replaced; all others are kept. An empty
    table gives an empty one. A text column makes no difference, whatever its length.
    """
    size = size or prime_from(SLOTS_PER_SHARD * len(shards))
    table = slot_table(records.sparkSession, shards, size)
    kept = [c for c in records.columns if c not in ("slot", "shard")]
    # rows travel as one column, so their columns may have any names
    rows = records.select(F.struct(*kept).alias("row"), slot_of(F.col(key), size).alias("at"))
    return rows.join(F.broadcast(table), F.col("at") == F.col("slot"), "left").select("row.*", "slot", "shard")
