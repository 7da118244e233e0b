"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

Text is read as UTF-8 bytes. A word's hash is the mixed sum of a random 64-bit number for each
(position, byte), so two different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPAN = 64
_TABLE = np.frombuffer(
    b"".join(hashlib.blake2b(str(i).encode(), digest_size=64).digest() for i in range(_SPAN * 256 // 8)),
    dtype="<u8",
).copy()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words for ``[^\x20\x09-\x0D]+``: all but the space and the five control spaces.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; null is empty.

    A single longer text is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


class Words:
    """The words of one run of texts.

    ``start`` and ``end``: byte places; ``hash``: 64-bit hashes; ``bounds[i]:bounds[i+1]`` are the
    words of text ``i``.
    """

    __slots__ = ("start", "end", "hash", "bounds", "lower")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        begins[cut] = inside[cut]
        at = np.flatnonzero(inside)
        first = np.flatnonzero(begins[at])
        self.start = at[first]
        size = np.diff(np.append(first, len(at)))
        self.end = self.start + size
        self.lower = _LOWER[data]
        if len(first):
            place = np.arange(len(at)) - np.repeat(first, size)
            total = np.add.reduceat(_TABLE[((place & (_SPAN - 1)) << 8) | self.lower[at]], first)
            for i in np.flatnonzero(size > _SPAN):
                word = self.lower[self.start[i] : self.end[i]].tobytes()
                total[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            self.hash = mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.start, offsets)

    def word(self, i: int) -> bytes:
        return self.lower[self.start[i] : self.end[i]].tobytes()


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes (ignoring the bounds of texts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n + j])
    return out
