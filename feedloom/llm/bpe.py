"""Byte-level BPE: ranks and pattern of a public tokenizer, merges in length-bucketed matrices.

Pieces of equal length bucket are rows of one padded matrix. In each round every row merges its
leftmost pair of minimum rank; pair ranks come from an open-addressing hash table, merged rows are
closed up, and finished rows leave the matrix. Pieces longer than ``LONG`` tokens merge all
occurrences of their minimum that the sequential order would take one after the other anyway.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
LONG = 256
#: Pieces whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 200_000


class Ranks:
    """A rank vocabulary: token bytes by id, and the id that a pair of ids merges to."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                a, b = tokens.get(token[:i]), tokens.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        key = np.fromiter(pairs, np.uint64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.shift = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys = np.full(slots, np.uint64(2**64 - 1))
        self.ranks = np.full(slots, _NONE)
        self.probes = 0
        slot = (key * _SPREAD) >> self.shift
        while len(key):
            self.probes += 1
            _, first = np.unique(slot, return_index=True)
            put = first[self.keys[slot[first]] == np.uint64(2**64 - 1)]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + np.uint64(1)) & np.uint64(slots - 1)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``_NONE`` where the pair doesn't merge or is padding (-1)."""
        key = left.astype(np.uint64) << np.uint64(32) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = (key * _SPREAD) >> self.shift
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NONE)
        for step in range(1, self.probes):
            at = (slot + np.uint64(step)) & np.uint64(len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.ranks[at[hit]]
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge the rows of ``ids`` (padded with -1) to their ends."""
        out: list = [None] * len(ids)
        row = np.arange(len(ids))
        rank = self.of(ids[:, :-1], ids[:, 1:])
        while len(ids):
            j = rank.argmin(axis=1)
            at = np.arange(len(ids))
            low = rank[at, j]
            done = low == _NONE
            if done.any():
                for r, tokens in zip(row[done], ids[done], strict=True):
                    out[r] = tokens[tokens >= 0]
                live = ~done
                ids, rank, row, j, low = ids[live], rank[live], row[live], j[live], low[live]
                if not len(ids):
                    break
                at = np.arange(len(ids))
            width = ids.shape[1]
            ids[at, j] = low
            source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > j[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            if width == 2:
                for r, tokens in zip(row, ids, strict=True):
                    out[r] = tokens
                break
            rank = np.take_along_axis(rank, source[:, :-1] + (source[:, :-1] == j[:, None]), axis=1)
            before, after = np.flatnonzero(j > 0), np.flatnonzero(j < width - 2)
            rank[before, j[before] - 1] = self.of(ids[before, j[before] - 1], ids[before, j[before]])
            rank[after, j[after]] = self.of(ids[after, j[after]], ids[after, j[after] + 1])
        return out

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row; the result is that of single merges in order."""
        while len(ids) > 1:
            rank = self.of(ids[:-1], ids[1:])
            low = rank.min()
            if low == _NONE:
                break
            at = np.flatnonzero(rank == low)
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
            nth = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[nth % 2 == 0]
            merged = np.full(len(at), low)
            left = ids[np.maximum(at - 1, 0)].copy()
            left[1:][at[1:] - 2 == at[:-1]] = low
            left[at == 0] = -1
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            stop = np.flatnonzero((self.of(left, merged) <= low) | (self.of(merged, right) <= low))
            if len(stop):
                at = at[: stop[0] + 1]
            ids = ids.copy()
            ids[at] = low
            ids = np.delete(ids, at + 1)
        return ids

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids (little-endian, 32 bits) of each piece, merged on its own."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.tokens.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif not piece:
                out[i] = b""
            elif len(piece) > LONG:
                out[i] = self._long(self.byte[np.frombuffer(piece, np.uint8)]).astype("<u4").tobytes()
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for a in range(0, len(rows), step := max(1, (1 << 18) // width)):
                part = rows[a : a + step]
                ids = np.full((len(part), width), -1, np.int32)
                size = np.array([len(pieces[i]) for i in part])
                ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, tokens in zip(part, self._matrix(ids), strict=True):
                    out[i] = tokens.astype("<u4").tobytes()
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _unicode_space(pattern: str) -> str:
    """``\\s`` as the Unicode property, as in the regular expressions of the tokenizer's library."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


_LOADED: dict[int, Ranks] = {}


def _ranks(shared) -> Ranks:
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = Ranks(shared.value)
    return _LOADED[shared.id]


class _Shared:
    """A broadcast vocabulary with its id, so that a Python worker builds its tables once."""

    def __init__(self, spark: SparkSession, tokens: dict[bytes, int]):
        self.of = spark.sparkContext.broadcast(tokens)
        self.id = self.of._jbroadcast.id()

    def __reduce__(self):
        return _Loaded, (self.of, self.id)


class _Loaded:
    def __init__(self, of, id_):
        self.of, self.id = of, id_

    @property
    def value(self):
        return self.of.value


def _encoded(shared, pattern: str):
    split = regex.compile(_unicode_space(pattern)).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(shared)
        known: dict[str, bytes] = {}
        for batch in batches:
            texts = batch.column("text").fill_null("")
            packed: list[bytes] = []
            pending: list[list[str]] = []
            held = 0

            def flush(pending=pending, packed=packed, known=known):
                if len(known) > REMEMBERED:
                    known.clear()
                new = [x for x in set(chain.from_iterable(pending)) if x not in known]
                known.update(zip(new, ranks.encode([x.encode() for x in new]), strict=True))
                packed.extend(b"".join(map(known.__getitem__, pieces)) for pieces in pending)
                pending.clear()

            for text in texts:
                text = text.as_py()
                pending.append(split(text))
                held += len(text)
                if held > 1 << 20:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return run


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: t for t, i in shared.value.items()}.__getitem__
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                raw = ids.as_buffer()
                out.append(None if raw is None else b"".join(map(by_id, np.frombuffer(raw, "<u4").tolist())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every row: ids of the whole text, packed as little-endian 32-bit numbers.

    Each match of ``pattern`` is merged on its own and no special token is known, so their strings
    are ordinary text. A null or empty text has no ids. Rows are kept as they are, repeated ones
    too; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary"
    return rows.mapInArrow(_encoded(_Shared(spark, read_ranks(ranks_path)), pattern), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that the packed ``ids`` stand for (null: null).

    An id that the vocabulary lacks is an error. A column that is named ``decoded`` already is replaced.
    """
    spark, encoded = encoded.sparkSession, encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return encoded.mapInArrow(_decoded(_Shared(spark, read_ranks(ranks_path))), schema)
