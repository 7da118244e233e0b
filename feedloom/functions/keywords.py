"""Which texts hold any of many keywords, byte by byte on Arrow columns.

Every place of a text is looked up by its first bytes, as many as a short keyword has or ``_WHOLE``. Where a
longer keyword may begin, the window of each length that such keywords have is looked up by its hash, and what
is found is compared. So work follows the bytes of the texts, not the number of keywords.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bytes by which places are looked up, at most; places that are taken at once; bits of the first lookup.
_WHOLE, _STEP, _BITS = 8, 1 << 19, 20
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


@cache
def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def _heads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end, as one number."""
    room = np.zeros(len(data) + 2 * _WHOLE, np.uint8)
    room[: len(data)] = data
    out = np.empty(len(data), "<u8")
    for i in range(min(_WHOLE, len(data))):
        own = out[i::_WHOLE]
        own[:] = room[i : i + _WHOLE * len(own)].view("<u8")
    return out


def _slot(heads: np.ndarray) -> np.ndarray:
    return heads * np.uint64(_ODD) >> np.uint64(64 - _BITS)


def _sums(data: np.ndarray, n: int) -> np.ndarray:
    """Sums of a polynomial in the bytes before each place; ``n`` is the most bytes that there may be."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers(_ODD, n)[: len(data)], out=out[1:])
    return out


def _found(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` are in the sorted ``known``, and where."""
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    own = np.flatnonzero(known[at] == x)
    return own, at[own]


class Keywords:
    """Keywords, none of them empty, and how they are found."""

    def __init__(self, words: list[str]):
        coded = sorted({w.encode() for w in words}, key=lambda w: (len(w), w))
        size = np.array([len(w) for w in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        start = np.cumsum(size) - size
        head = _heads(data)[start]
        self.longest = int(size.max(initial=0))
        self.heads, self.slots = {}, {}
        for n in np.unique(np.minimum(size, _WHOLE)).tolist():
            own = head[size >= n if n == _WHOLE else size == n] & np.uint64((1 << 8 * n) - 1)
            self.heads[n] = np.unique(own)
            self.slots[n] = np.zeros(1 << _BITS, bool)
            self.slots[n][_slot(self.heads[n])] = True
        long = np.flatnonzero(size >= _WHOLE)
        self.long = {coded[i] for i in long}
        if len(long):
            n, sums, start, size = len(data), _sums(data, len(data)), start[long], size[long]
            self.hashes = np.unique((sums[start + size] - sums[start]) * _powers(_BACK, n)[start] + size.astype(np.uint64))
            pairs = np.unique(np.stack([_found(head[long], self.heads[_WHOLE])[1], size]), axis=1)
            self.lengths = pairs[1]
            self.first = np.searchsorted(pairs[0], np.arange(len(self.heads[_WHOLE]) + 1))

    def occur(self, texts: pa.Array) -> np.ndarray:
        """For each text whether a keyword occurs; null is empty."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        hit = np.zeros(len(texts), bool)
        _, offsets, data = texts.buffers()
        if not self.longest or not len(texts) or data is None:
            return hit
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)
        for a in range(int(at[0]), int(at[-1]), _STEP):
            piece = raw[a : min(a + _STEP + self.longest, int(at[-1]))]
            heads, sums = _heads(piece)[:_STEP], None
            for n, known in self.heads.items():
                own = heads & np.uint64((1 << 8 * n) - 1) if n < _WHOLE else heads
                place = np.flatnonzero(self.slots[n][_slot(own)])
                told, head = _found(own[place], known)
                place = place[told]
                row = np.searchsorted(at, place + a, "right") - 1
                room = at[row + 1] - a - place
                if n < _WHOLE:
                    hit[row[room >= n]] = True
                    continue
                for k in range(int((self.first[head + 1] - self.first[head]).max(initial=0))):
                    open_ = (self.first[head] + k < self.first[head + 1]) & ~hit[row]
                    place, head, row, room = place[open_], head[open_], row[open_], room[open_]
                    size = self.lengths[self.first[head] + k]
                    fit = np.flatnonzero(size <= room)
                    if len(fit):
                        sums = _sums(piece, _STEP + self.longest) if sums is None else sums
                        p, size = place[fit], size[fit]
                        window = (sums[p + size] - sums[p]) * _powers(_BACK, _STEP + self.longest)[p] + size.astype(np.uint64)
                        for i in _found(window, self.hashes)[0].tolist():
                            r = row[fit[i]]
                            hit[r] = hit[r] or piece[p[i] : p[i] + size[i]].tobytes() in self.long
        return hit


def occurs(keywords: Broadcast, title: Column, abstract: Column) -> Column:
    """Whether one of the broadcast :class:`Keywords` occurs in either column."""

    @F.arrow_udf(BooleanType())
    def found(title: pa.Array, abstract: pa.Array) -> pa.Array:
        return pa.array(keywords.value.occur(title) | keywords.value.occur(abstract))

    return found(title, abstract)
