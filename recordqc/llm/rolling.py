"""Prefix polynomials of byte buffers: hashes of any of their substrings at once, and bit tables of fixed size."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordqc.llm.shingles import mixed

#: Two odd bases; arithmetic is modulo 2**64, in which odd numbers have inverses.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: log2 of the bits of a table, and bits in one of its rows.
TABLE_BITS, ROW_BITS = 27, 1 << 15


@lru_cache(16)
def _powers(base: int, size: int) -> np.ndarray:
    a = np.full(size, base, np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n``."""
    return _powers(base % 2 ** 64, -(-n // 2 ** 18) * 2 ** 18)[:n]


class Prefixes:
    """``sums[i]`` is the polynomial of the first ``i`` bytes; a difference of two is a substring's, moved by its start."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.base = base
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * powers(base, len(data)), out=self.sums[1:])
        self.back = powers(pow(base, -1, 2 ** 64), len(data) + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each ``data[start:end]``, its length included."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + mixed((end - start).astype(np.uint64)))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each position on."""
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n else np.zeros(0, np.uint64)


def table_of(keys: DataFrame, column: str = "key", bits: int = TABLE_BITS) -> bytes:
    """A table of 2**bits bits in which the bit of every value of a long column is set.

    It has 16 MB whatever the number of values, so it may go to the driver and to every task; a value that was
    not put in is found with the share of bits set, so a table may only spare work and never decide.
    """
    top = (1 << bits) // ROW_BITS

    def rows(batches):
        import pyarrow as pa
        table = np.zeros(1 << bits >> 3, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        table = table.reshape(top, -1)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[r].tobytes() for r in some], pa.binary())], names=["r", "b"])

    placed = keys.select(F.col(column).alias("key")).repartition(F.shiftrightunsigned("key", 64 - bits + ROW_BITS.bit_length() - 1))
    table = np.zeros((top, ROW_BITS // 8), np.uint8)
    for r in placed.mapInArrow(rows, "r int, b binary").toLocalIterator():
        table[r["r"]] |= np.frombuffer(r["b"], np.uint8)
    return table.tobytes()


def found(table: bytes, keys: np.ndarray) -> np.ndarray:
    """Which values may be in the table."""
    if not len(keys):
        return np.zeros(0, bool)
    t = np.frombuffer(table, np.uint8)
    at = keys.view(np.uint64) >> np.uint64(64 - (len(t) * 8).bit_length() + 1)
    return (t[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
