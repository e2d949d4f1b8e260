"""Words of many texts at once as numpy arrays: boundaries, 64-bit word hashes, hashes of word runs.

Texts come as Arrow string columns and are read as UTF-8 bytes. A hash is a polynomial over bytes (or
words) modulo 2**64 with a fixed random value per byte, taken from prefix sums and then mixed, so a
whole chunk needs a handful of array operations, whatever the length of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 2 << 20


class Words(NamedTuple):
    """Words of a chunk of texts: byte ranges in `data`, the row each belongs to, its hash; `first[r]:first[r+1]` are those of row r."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.full(n, b, dtype=np.uint64) for b in (BASE, inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n at least."""
    return _powers(max(16, int(n).bit_length()))


def byte_values(lower: bool = False) -> np.ndarray:
    """A fixed 64-bit value per byte; `lower`: A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        values[65:91] = values[97:123]
    return values


def not_space() -> np.ndarray:
    """Bytes of words that are runs of anything but white space (0x20, 0x09-0x0D)."""
    keep = np.ones(256, dtype=bool)
    keep[[0x20, 9, 10, 11, 12, 13]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """Bytes of words that are runs of ASCII letters, digits and anything beyond ASCII."""
    keep = np.zeros(256, dtype=bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: none) and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a chunk by itself."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def words(column: pa.Array, keep: np.ndarray, values: np.ndarray) -> Words:
    data, offsets = utf8(column)
    n = len(data)
    inside = keep[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[begin]) * down[begin])
    first = np.searchsorted(begin, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, begin, end, row, hashed, first, offsets)


def run_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which `run_hash` takes the hash of any run of consecutive words."""
    up, _ = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, begin: np.ndarray, length) -> np.ndarray:
    """Hash of the words begin .. begin + length - 1; the length takes part."""
    _, down = powers(len(sums))
    return mix((sums[begin + length] - sums[begin]) * down[begin] + np.asarray(length, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def run_starts(w: Words, length: int) -> np.ndarray:
    """Positions at which a run of `length` words of one row begins."""
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(w.row[:n] == w.row[length - 1:])
