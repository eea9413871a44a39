"""Words of filing documents: runs of bytes that are not ASCII white space, and integer ids for them."""
from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = WORD.pattern


def words_of(text: bytes) -> list[bytes]:
    """Words in order. Of bytes, split() cuts at exactly the six ASCII white-space characters."""
    return text.split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound so that frequent words are hashed once. Long words are not kept."""

    LIMIT = 100_000
    LONGEST = 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT and len(word) <= self.LONGEST:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


HASH_SLOTS = 1 << 30


def likely_first(key: str, wanted: int, among: Column | int) -> Column:
    """Keeps about four times ``wanted`` of ``among`` rows, those whose key has a small hash, and all if there are fewer.

    The first ``wanted`` rows in hash order are then found among few, whatever the size of the table.
    """
    among = F.lit(among) if isinstance(among, int) else among
    return F.pmod(F.xxhash64(key), F.lit(HASH_SLOTS)) * among < 4.0 * wanted * HASH_SLOTS
