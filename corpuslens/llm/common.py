"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter that is sent to every task; its size does not depend on the data.
FILTER_BITS = 1 << 24


def bit_filter(df: DataFrame, key: Column, bits: int = FILTER_BITS) -> bytes:
    """Bit set of ``key`` modulo ``bits``, built by aggregation: at most ``bits / 8`` bytes reach the driver.

    A key that is not in ``df`` may pass it, one that is always does; what passes is joined
    exactly afterwards, so a crowded filter costs time, never results.
    """
    slot = F.pmod(key, F.lit(bits)) + 1
    parts = df.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = bytearray(bits // 8)
    for row in parts.collect():
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = row["bits"]
    return bytes(out)


def passes(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit signed keys may be in the set."""
    slot = keys.astype(np.int64) % np.int64(8 * len(bits))
    return (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words last seen."""

    def __init__(self, keep: int = 250_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
