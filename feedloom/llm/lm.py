"""Language-model scores of documents, learnt from the corpus itself: a probabilistic suffix tree of words.

Symbols are the words of a text, then one end; a text's first context is the boundary. The root
predicts each by its smoothed frequency. A context of the last 1, 2, 3, 4, 8, 16, ... symbols is
retained if its next-symbol distribution, smoothed towards that of the longest retained suffix,
differs from it by a likelihood ratio of ``GAIN`` nats over the training texts, where each occurrence is
judged by the counts of all others, so chance successors are no divergence. A context can be retained
only with ``SUPPORT`` occurrences, and longer ones are tried only while ``GAIN`` nats are left in it, as
no longer one could pass the test elsewhere; so depth and number of states follow the corpus. A
symbol is scored by the longest retained suffix of what precedes it.

Texts are packed into blocks, once and without a shuffle. At each length a block asks once for each of
its distinct (context, next symbol), and for each of its contexts; the task that gets a key from all
blocks answers with its total. At the short lengths, where nearly all places ask, the symbols are written once and not
with each state, and asks are made from the states round by round and written nowhere but in the shuffle. A key is a 64-bit hash and spread by its own value, so neither a
frequent word nor a frequent context, nor a text that is a third of all rows, is a hot group. Test
sums are whole numbers (fixed point), so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Container, Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.runtime import bytes_in, deleted, deleted_table, dropped, settled, shuffle_partitions, written
from feedloom.llm.wordhash import SPACED, Words, mix, text_chunks

#: Pseudo-counts given to the suffix; nats to be retained, or to grow; occurrences that a context needs.
WEIGHT, GAIN, SUPPORT = 16.0, 6.0, 8
#: Bytes of text in a block, about (it bounds what a task holds), and of input for each part of the keys.
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: Bytes of packs for each part and bucket when they get fewer.
PACK_BYTES = 4 << 20
_PIECE = 1 << 15
_UNIT = float(1 << 20)
_END = np.uint64(0x5851F42D4C957F2D)
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_NEXT, _ANY = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Asks of a step are answered in up to so many rounds, so that what is shuffled lies on disk in part only. They are
#: answered at once where states have come down to this part of the most that they had, as their asks have, too.
ROUNDS, FEW = 2, 2 / 3
#: From this step on states hold their symbols, of which few are left then, and asks are written with them.
WHOLE = 5


def longer(length: int) -> int:
    """The next length of contexts."""
    return length + 1 if length < 4 else 2 * length


def shorter(length: int) -> int:
    """The length before."""
    return length - 1 if length <= 4 else length // 2


@cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays by name, compressed byte by byte of their numbers; high bytes that are 0 everywhere are left out."""
    head, body = [], []
    for name, x in arrays.items():
        size = used = x.dtype.itemsize
        if len(x) and size > 1 and x.dtype.kind in "iu" and x.min() >= 0:
            used = max(1, -(-int(x.max()).bit_length() // 8))
        own, planes = np.ascontiguousarray(x).view(np.uint8), np.empty((used, len(x)), np.uint8)
        for i in range(used):
            planes[i] = own[i::size]
        body.append(_codec().compress(planes, asbytes=True) if len(x) else b"")
        head.append((name, x.dtype.str, len(x), used, len(body[-1])))
    first = json.dumps(head).encode()
    return len(first).to_bytes(4, "little") + first + b"".join(body)


def _unpacked(pack: pa.Scalar, but: Container[str] = ()) -> dict[str, np.ndarray]:
    """The arrays of a pack, ``but`` some."""
    raw = memoryview(pack.as_buffer())
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n, used, size in json.loads(bytes(raw[4:at])):
        if name not in but:
            width = np.dtype(kind).itemsize
            out[name] = np.empty(n, kind) if used == width else np.zeros(n, kind)
            if n:
                own, planes = out[name].view(np.uint8), np.frombuffer(_codec().decompress(raw[at : at + size], n * used), np.uint8)
                for i in range(used):
                    own[i::width] = planes[i * n : i * n + n]
        at += size
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each of ``keys`` there."""
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).view(np.int64)  # high bits of the key, then its place
    known = keys[order]
    if (known[1:] < known[:-1]).any():  # keys that differ in their low bits only
        order = np.argsort(keys)
        known = keys[order]
    first = np.ones(len(known), bool)
    np.not_equal(known[1:], known[:-1], out=first[1:])
    place = np.empty(len(known), np.uint32)
    place[order] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
    return known.compress(first), place


def _piecewise(keys_of: Callable, *of: np.ndarray) -> np.ndarray:
    """The keys of places, made by pieces whose arrays stay in the processor's cache."""
    out = np.empty(len(of[0]), np.uint64)
    for i in range(0, len(out), _PIECE):
        out[i : i + _PIECE] = keys_of(*(x[i : i + _PIECE] for x in of))
    return out


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of ``bits`` bits that spreads them; the result is in the high bits."""
    most, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = x * np.uint64(odd) & most
        x = x ^ (x >> half)
    return x << np.uint64(64 - bits)


@cache
def _edges(parts: int) -> np.ndarray:
    """The least key of each part."""
    return np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)


def _asked(parts: int, kind: str, keys: np.ndarray, bits: int = 64, empty: bool = False, **values: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
    """A pack for each part (also for those without keys, if ``empty``) of sorted ``keys``, which have ``bits`` high bits, and their values; the part goes by a key's high bits."""
    low = {"low": np.array([64 - bits], np.uint8)} if bits < 64 else {}
    bounds = [*np.searchsorted(keys, _edges(parts)), len(keys)]
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if b > a or empty:
            own = keys[a:b]
            yield p, kind, _packed(step=np.diff(own >> np.uint64(64 - bits), prepend=np.uint64(0)), **low, **{c: x[a:b] for c, x in values.items()})


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of a part, in the order asked: ``count`` totals, ``word`` totals and numbers of the words, or for ``test`` whether to retain (1) and to grow (2)."""
    settled()
    asked: dict[tuple[int, str], list] = {}
    for batch in batches:
        for block, part, kind, pack in zip(*(batch.column(c) for c in ("block", "part", "kind", "pack")), strict=True):
            got = _unpacked(pack)
            low = got.pop("low", np.zeros(1, np.uint8))[0]
            got["key"] = np.cumsum(got.pop("step"), dtype=np.uint64) << np.uint64(low)
            asked.setdefault((part.as_py(), kind.as_py()), []).append((block.as_py(), got))
    for (part, kind), rows in asked.items():
        known, place = _distinct(np.concatenate([r.pop("key") for _, r in rows]))
        size = [len(next(iter(r.values()))) for _, r in rows]
        total = lambda c: np.bincount(place, np.concatenate([r[c] for _, r in rows]), len(known))  # noqa: E731, B023
        if kind == "test":
            kept = total("gain") >= GAIN * _UNIT
            left = np.where(kept, total("own"), total("under"))
            answer = (kept + 2 * (left >= GAIN * _UNIT)).astype(np.uint8)
            head: dict = {}
        else:
            answer = _small(total("n").astype(np.int64))
            head = {"head": np.array([answer.sum(dtype=np.int64), (answer > 0).sum()], np.int64)}
        ends = np.cumsum(size)[:-1]
        each = [{"answer": x} | head for x in np.split(answer[place], ends)]
        if kind == "word":  # a block's words are in order, so their places are, too
            most = np.array([len(known)], np.int64)
            each = [x | {"number": np.diff(at, prepend=np.uint32(0)), "most": most} for x, at in zip(each, np.split(place, ends), strict=True)]
        yield _rows_of([(block, part, kind, _packed(**x)) for (block, _), x in zip(rows, each, strict=True)])


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    block, part, kind, pack = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(kind, pa.string()), pa.array(pack, pa.binary())],
        names=["block", "part", "kind", "pack"],
    )


@cache
def _powers(x: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, x, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class _Stream:
    """The symbols of a block: for each text the boundary, its words, and the end; both marks are ``_END``."""

    def __init__(self, state: dict[str, np.ndarray]):
        self.known, self.place, self.size = state["known"], state["place"], state["size"]
        self.bits = max(1, int(state["words"][0] - 1).bit_length())
        self.kept = state["kept"] if "kept" in state else self.size + 2  # symbols of each text that are held
        self.start = np.cumsum(self.kept) - self.kept
        self.learn = state["learn"].astype(bool)

    @cached_property
    def before(self) -> np.ndarray:
        return (np.arange(len(self.place)) - np.repeat(self.start, self.kept)).astype(np.int32)

    @cached_property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.kept)

    @cached_property
    def learnt(self) -> np.ndarray:
        return np.repeat(self.learn, self.kept)

    @cached_property
    def hash(self) -> np.ndarray:
        return mix(self.known.astype(np.uint64) + _NEXT)[self.place]

    @cached_property
    def sum(self) -> np.ndarray:
        n = len(self.place)
        out = np.zeros(n + 1, np.uint64)
        np.multiply(self.hash, self._powers(_ODD, n), out=out[1:])
        return np.cumsum(out, out=out)

    @cached_property
    def back(self) -> np.ndarray:
        return self._powers(_BACK, len(self.place))

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        bits = max(16, n.bit_length())
        if bits > 21:  # a very long text: not held for the next block
            return _powers.__wrapped__(x, bits)[:n]
        return _powers(x, bits)[:n]

    def context(self, at: np.ndarray, length: int) -> np.ndarray:
        """A hash of the ``length`` symbols before each place."""
        return _piecewise(lambda at: mix((self.sum[at] - self.sum[at - length]) * self.back[at] + np.uint64(length)), at)

    def next(self, context: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _piecewise(lambda context, at: mix(context * _NEXT + self.hash[at]), context, at)

    @cached_property
    def number(self) -> np.ndarray:
        return self.known[self.place]

    def tested(self, at: np.ndarray, length: int) -> tuple[np.ndarray, int]:
        """The keys of contexts in tests, and their bits: one or two symbols are their numbers, if these fit."""
        if length == 1 and self.bits < 64:
            return self.single[self.place[at - 1]], self.bits
        if length == 2 and self.bits <= 32:
            return self.pair(at - 1), 2 * self.bits
        return self.context(at, length), 64

    @cached_property
    def single(self) -> np.ndarray:
        return _spread(self.known.astype(np.uint64), self.bits)

    def tests(self, at: np.ndarray, length: int, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of contexts in tests, in order, and the place of each there; ``keys``: those of the contexts."""
        if length == 1 and self.bits < 64:  # words are sorted, not their occurrences
            word = self.place[at - 1]
            used = np.flatnonzero(np.bincount(word, minlength=len(self.known)))
            used = used[np.argsort(self.single[used])]
            rank = np.zeros(len(self.known), np.uint32)
            rank[used] = np.arange(len(used), dtype=np.uint32)
            return self.single[used], rank[word]
        return _distinct(self.tested(at, length)[0] if keys is None else keys)

    def pair_bits(self, length: int) -> int:
        """Bits of a key of (context, symbol): two symbols are their numbers, if these fit."""
        return 2 * self.bits if length == 1 and self.bits <= 32 else 64

    def pair(self, at: np.ndarray) -> np.ndarray:
        return _piecewise(lambda at: _spread(self.number[at - 1].astype(np.uint64) << np.uint64(self.bits) | self.number[at], 2 * self.bits), at)


def _counted(stream: _Stream, place: np.ndarray, length: int, ask: np.ndarray) -> np.ndarray:
    """What is counted of contexts: the keys of (context, symbol), and then of contexts whose count isn't known."""
    if length == 1 and stream.bits <= 32:  # the counts of all words are known
        return stream.pair(place)
    context = stream.context(place, length)
    return np.concatenate([stream.next(context, place), mix(context[ask] + _ANY)])


#: What a block's texts are written with, once.
_TEXTS = ("ids", "place", "size", "learn", "rank")
#: What asks are made without.
_TOLD = ("ids", "rank", "base", "n_known", "score")


def _state_of(block: int, state: dict[str, np.ndarray], whole: bool) -> tuple[int, int, str, bytes]:
    """The row of a state: ``state`` if it asks, else ``done``; only a whole one holds its symbols."""
    own = {c: x for c, x in state.items() if (whole and c != "rank") or c not in _TEXTS}
    own["known"] = np.diff(own["known"], prepend=own["known"].dtype.type(0))  # words as frequent in the block are in order
    return block, -1, "state" if len(state["live"]) else "done", _packed(**own)


def _state_in(*packs: pa.Scalar, but: Container[str] = ()) -> dict[str, np.ndarray]:
    state = {c: x for pack in packs for c, x in _unpacked(pack, but).items()}
    if "known" in state:
        state["known"] = np.cumsum(state["known"], dtype=state["known"].dtype)
    return state


def _begun(parts: int):
    """Blocks of texts: their state, which keeps ids as an Arrow stream, and what they ask for words."""

    def block_of(block: int, ids: list, texts: list) -> pa.RecordBatch:
        rows = pa.Table.from_batches(ids)
        hashes, size = (np.concatenate(x) for x in zip(*texts, strict=True))
        learn = ~rows.column("held_out").to_numpy()
        code, known = pd.factorize(np.append(hashes, _END))
        order = np.lexsort((known, -np.bincount(code)))  # frequent words get small numbers, which pack well
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        code, known = back[code], known[order]
        start = np.cumsum(size + 2) - size - 2
        place = np.full(int((size + 2).sum()), code[-1], np.uint32)
        place[np.arange(len(hashes)) + np.repeat(start + 1 - (np.cumsum(size) - size), size)] = code[:-1]
        n = np.bincount(code[:-1][np.repeat(learn, size)], minlength=len(known))
        n[code[-1]] += learn.sum()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        by = np.argsort(known)
        rank = np.empty(len(by), np.uint32)
        rank[by] = np.arange(len(by), dtype=np.uint32)
        state = {"ids": np.frombuffer(sink.getvalue(), np.uint8), "place": place, "size": size, "learn": learn, "rank": np.diff(rank, prepend=np.uint32(0))}
        asks = _asked(parts, "word", known[by], empty=True, n=_small(n[by]))  # all tell their part of N and V
        return _rows_of([(block, -1, "texts", _packed(**state)), *((block, *x) for x in asks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled()
        block = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column("text"), 1 << 20):
                words = Words(data, offsets, SPACED)
                ids.append(batch.slice(first, end - first).select(["doc_id", "held_out"]))
                texts.append((words.hash, np.diff(words.bounds)))
                held += len(data) + end - first
                if held >= BLOCK_BYTES:
                    yield block_of(block, ids, texts)
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield block_of(block, ids, texts)

    return run


def _answers(table: pa.Table, parts: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A block's answers by kind in the order of the keys asked, and the totals of all parts."""
    got, head, number, most = {}, np.zeros(2, np.int64), [], 0
    for part, kind, pack in sorted(zip(table.column("part").to_pylist(), table.column("kind").to_pylist(), table.column("pack"), strict=True), key=lambda x: x[0]):
        own = _unpacked(pack)
        got.setdefault(kind, []).append(own["answer"])
        if kind == "word":
            number.append((part, np.cumsum(own["number"], dtype=np.uint64)))
            most = max(most, int(own["most"][0]))
        head += own.get("head", 0)
    if number:  # they ascend with the keys
        got["number"] = [x + np.uint64(part * most) for part, x in number]
        got["most"] = [np.array([parts * most], np.int64)]
    return {k: np.concatenate(x) for k, x in got.items()}, head


def _bits(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).view(bool)


def _live(state: dict[str, np.ndarray], stream: _Stream) -> np.ndarray:
    return np.flatnonzero(_bits(state["live"], len(stream.place) if len(state["live"]) else 0))


def _probability(state: dict[str, np.ndarray], stream: _Stream, at: np.ndarray, own=slice(None)) -> np.ndarray:
    """The probability of places by retained contexts; ``own`` are their rows in the state."""
    if "p" in state:
        return state["p"][own].astype(float)
    p = _root(state)[stream.place[at]]
    if "told" not in state:
        return p
    told = _bits(state["told"], len(state["shorter_n"]))[own]
    return np.where(told, _smooth(state["shorter_n"][own], p, state["count"][stream.place[at - 1]]), p).astype(np.float32).astype(float)


def _smooth(n: np.ndarray, p: np.ndarray, support: np.ndarray) -> np.ndarray:
    return (n + WEIGHT * p) / (support + WEIGHT)


def _to_count(state: dict[str, np.ndarray], stream: _Stream, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which live places ask for counts at this length, and the counts of their contexts: 0 is not known."""
    if length == 1:
        return np.ones(len(at), bool), state["count"][stream.place[at - 1]].astype(np.int64)
    counted = _bits(state["counted"], len(at))
    if length > 4:
        return counted, np.zeros(counted.sum(), np.int64)
    full = np.full(len(stream.place), -1, np.int64)
    full[at] = state["n"]
    support = full[at.compress(counted) - 1]
    support[support < 0] = state["known_support"]
    return counted, support


def _asks(parts: int, stream: _Stream, state: dict[str, np.ndarray], k: int, length: int, part: int = 0, span: int = 0) -> Iterator[tuple[int, str, bytes]]:
    """What a block asks after step ``k``: tests of its contexts of ``length``, and counts at the next; keys of ``span`` parts from ``part`` on, or of all."""
    end = part + span if span else parts

    def mine(keys: np.ndarray) -> np.ndarray | slice:
        if not span:
            return slice(None)
        edges = _edges(parts)
        own = keys >= edges[part]
        return np.flatnonzero(own & (keys < edges[end]) if end < parts else own)

    at = _live(state, stream)
    if not len(at):
        return
    if k > 0:
        context, bits = stream.tested(at, length)
        own = mine(context)
        place = at[own]
        keys, of = stream.tests(place, length, context[own])
        learn = np.flatnonzero(stream.learnt[place])
        at_, of_learn = place[learn], of[learn]
        own = learn if isinstance(own, slice) else own[learn]
        n, p = state["n"][own].astype(np.int64), _probability(state, stream, at_, own)
        if k == 1:
            support = state["count"][stream.place[at_ - 1]].astype(np.int64)
        else:
            support = state["support"][state["bounds"][part] if span else 0 :][of_learn].astype(np.int64)
        summed = lambda x: np.bincount(of_learn, np.rint(x * _UNIT), len(keys)).astype(np.int64)
        others = _smooth(n - 1, p, support - 1)
        most = np.int64(GAIN * _UNIT)  # no term is negative, so a sum that is left reaches GAIN with or without what is over it
        left = lambda q: np.minimum(summed(-np.log(q)), most)
        yield from _asked(parts, "test", keys, bits, gain=summed(np.log(others / p)), own=left(_smooth(n, p, support)), under=left(p))
    size = longer(length) if k > 0 else 1
    if size == 1 and stream.bits <= 32:  # all, and no count of a context
        place, ask = at, at[:0]
    else:
        counted, support = _to_count(state, stream, at, size)
        place, ask = at.compress(counted), np.flatnonzero(support == 0)
    keys, learn = _counted(stream, place, size, ask), stream.learnt[place]
    own = mine(keys)
    learn = (learn if len(keys) == len(place) else np.concatenate([learn, learn[ask]]))[own]
    keys, of = _distinct(keys[own])
    yield from _asked(parts, "count", keys, stream.pair_bits(size), n=_small(np.bincount(of.compress(learn), minlength=len(keys))))


def _taken(state: dict[str, np.ndarray], stream: _Stream, got: dict[str, np.ndarray], k: int, length: int, parts: int) -> np.ndarray:
    """Take in what a block asked after step ``k - 1``: ``length`` is that of the contexts counted now. The places that stay live.

    Of a live place (a symbol whose longest suffix isn't known yet) the state has ``p``, its probability by
    retained contexts (left out while that is the root's, or follows from ``shorter_n`` of single words), and of the context in
    test the count ``n`` of the symbol. Which answer is a place's, and the count of a context that is the ``n`` of the place before,
    are worked out again from the symbols, as they would be half of the state.
    """
    at = _live(state, stream)
    p = _probability(state, stream, at)

    def done(rows: np.ndarray) -> None:
        rows = np.flatnonzero(rows)
        state["score"] += np.bincount(stream.text[at[rows]], np.log10(p[rows]), len(stream.size))

    full = None
    if k > 0:
        counted, support = _to_count(state, stream, at, length)
        grow = np.ones(len(at), bool)
        if k > 1:  # the test of the contexts one step shorter
            of = stream.tests(at, shorter(length))[1]
            held = state.pop("support")[of] if k > 2 else state["count"][stream.place[at - 1]]
            told = got["test"][of]
            p, grow = np.where(told & 1, _smooth(state["n"], p, held), p), told & 2 > 0
        total, ask, place = np.zeros(len(at), np.int64), np.flatnonzero(support == 0), at.compress(counted)
        of = _distinct(_counted(stream, place, length, ask))[1]  # the counts of the contexts of this length
        answer = got["count"][of].astype(np.int64) if len(of) else np.zeros(0, np.int64)
        n, support[ask] = answer[: len(support)], answer[len(support) :]
        full = np.full(len(stream.place), -1, np.int64)
        full[place] = n
        total[counted] = support
        grow &= counted & (total >= SUPPORT)
        done(~grow)
        rows = np.flatnonzero(grow)
        at, p, support = at[rows], p[rows], total[rows]
        if k == 2:
            state |= {"shorter_n": state["n"][rows], "told": np.packbits(told[rows] & 1)}
        elif k > 2:
            state["p"] = p.astype(np.float32)
            for c in ("count", "shorter_n", "told"):
                state.pop(c, None)
        state["n"] = _small(full[at])
        if k > 1:
            keys, of = stream.tests(at, length)
            held = np.zeros(len(keys), np.int64)
            held[of] = support
            state |= {"support": _small(held), "bounds": np.searchsorted(keys, _edges(parts))}
    size = longer(length) if k > 0 else 1
    room = stream.before[at] >= size
    if k == 0:
        support = state["count"][stream.place[at - 1]].astype(np.int64)
    elif size == length + 1:  # the count of the symbol before is this context's
        support = full[at - 1]
        if k < 3:
            support = np.maximum(support, 1)  # not counted: too rare
    else:
        support = np.full(len(at), -1)
    counted = room & ((support < 0) | (support >= SUPPORT))  # contexts to be counted next
    if k == 0:
        done(~counted)
        at = at.compress(counted)
    else:
        live = np.zeros(len(stream.place), bool)
        live[at] = True
        rest = counted & ~live[at - 1] if size <= 4 else np.zeros(len(at), bool)
        state |= {"counted": np.packbits(counted), "known_support": _small(np.maximum(support.compress(rest), 0))}
    live = np.zeros(len(stream.place) if len(at) else 0, bool)
    live[at] = True
    state["live"] = np.packbits(live)
    return at


def _step(parts: int, k: int, length: int):
    """Step ``k`` of a block: what it asked is taken in, and from step ``WHOLE`` on it asks anew."""

    def run(key, own, table):
        settled()
        block, whole = key[0].as_py(), k >= WHOLE
        if k > WHOLE and own.column("kind")[0].as_py() == "done":
            return own
        state = _state_in(*(own.column(c)[0] for c in ("texts", "pack") if c in own.column_names), but=("rank",) if k else ())
        asks = []
        if k == 0 or len(state["live"]):
            got, head = _answers(table, parts)
            stream = _rooted(state, got, head) if k == 0 else _Stream(state)
            at = _taken(state, stream, got, k, length, parts)
            if whole and len(at):
                asks = [(block, *x) for x in _asks(parts, stream, state, k, length)]
                _forgotten(state, stream, at)
        if not len(state["live"]):
            for c in ("known", "place") if whole else ("known",):
                state[c] = state[c][:0]
            for c in ("kept", "count", "shorter_n", "told", "p", "n", "support", "bounds", "counted", "known_support"):
                state.pop(c, None)
        return pa.Table.from_batches([_rows_of([_state_of(block, state, whole), *asks])])

    return run


def _asking(parts: int, k: int, length: int, part: int, span: int):
    """What blocks ask after step ``k`` of ``span`` parts from ``part`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled()
        for batch in batches:
            for block, texts, pack in zip(*(batch.column(c) for c in ("block", "texts", "pack")), strict=True):
                state = _state_in(texts, pack, but=_TOLD)
                if rows := [(block.as_py(), *x) for x in _asks(parts, _Stream(state), state, k, length, part, span)]:
                    yield _rows_of(rows)

    return run


def _rooted(state: dict[str, np.ndarray], got: dict[str, np.ndarray], head: np.ndarray) -> _Stream:
    """The base columns of a block's texts, and the root's probability of each of its words, which become numbers."""
    rank = np.cumsum(state["rank"], dtype=np.uint32)
    count, state["known"], state["words"] = got["word"][rank].astype(np.int64), _small(got["number"][rank]), got["most"]
    stream = _Stream(state)
    tokens, kinds = int(head[0]), int(head[1])
    log = np.log10(count + 0.1)
    told = stream.before > 0
    text, place = stream.text[told], stream.place[told]
    n = stream.size + 1
    state["base"] = np.bincount(text, log[place], len(n)) - n * math.log10(tokens + 0.1 * (kinds + 1))
    state["n_known"] = np.bincount(text, count[place] > 0, len(n)).astype(np.int64)
    state["tokens"] = np.array([tokens, kinds])
    state["score"] = np.zeros(len(n))
    state["count"], state["live"] = _small(count), np.packbits(told)
    return stream


def _root(state: dict[str, np.ndarray]) -> np.ndarray:
    tokens, kinds = state["tokens"]
    return (state["count"] + 0.1) / (tokens + 0.1 * (kinds + 1))


def _forgotten(state: dict[str, np.ndarray], stream: _Stream, at: np.ndarray) -> None:
    """Keep of each text the symbols up to its last live place, if it has one, and the words that are left somewhere."""
    kept = np.zeros(len(stream.size), np.int64)
    kept[stream.text[at]] = stream.before[at] + 1  # places ascend, so the last is what stays
    need = stream.place.compress(stream.before < np.repeat(kept, stream.kept))
    held = np.bincount(need, minlength=len(stream.known)) > 0
    live = np.zeros(len(need), bool)
    live[at + (np.cumsum(kept) - kept - stream.start)[stream.text[at]]] = True
    state |= {"place": (np.cumsum(held) - 1)[need].astype(np.uint32), "kept": kept, "live": np.packbits(live)}
    for name in ("known", "count"):
        if name in state:
            state[name] = state[name][held]


def _told():
    """The rows of the blocks when no place is live any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled()
        for batch in batches:
            for pack in batch.column("pack"):
                state = _state_in(pack)
                ids = pa.ipc.open_stream(pa.py_buffer(state["ids"].tobytes())).read_all()
                n = len(state["size"])
                yield from pa.table(
                    {
                        "doc_id": ids.column("doc_id"),
                        "held_out": ids.column("held_out"),
                        "n_tokens": pa.array(state["size"].astype(np.int64) + 1),
                        "n_known": pa.array(state["n_known"]),
                        "train_tokens": pa.array(np.full(n, state["tokens"][0], np.int64)),
                        "base_score": pa.array(state["base"]),
                        "score": pa.array(state["score"]),
                    }
                ).to_batches()

    return run


_PACKS = "block long, part int, kind string, pack binary"


class _Step:
    """What a step has written: states, in buckets of blocks so that they aren't shuffled when answers come, and asks, if it is the first or a whole one."""

    def __init__(self, rows: DataFrame, buckets: int, parts: int, k: int, length: int, texts: DataFrame | None = None, most: int = 0):
        self.spark, self.parts, self.k, self.length = rows.sparkSession, parts, k, length
        self.rounds = max(1, min(ROUNDS, parts // self.spark.sparkContext.defaultParallelism))
        self.span = -(-parts // self.rounds)  # parts in a round
        asks = F.when(F.col("part") < 0, -1).otherwise(F.floor(F.col("part") / self.span).cast("int"))  # their round
        self.table = written(rows.withColumn("asks", asks), "step", by="asks", buckets=(buckets, "block"))
        self.path = self.table._table_path
        self.states = self.table.where("asks = -1").drop("asks")
        self.held, self.asked = bytes_in(self.spark, self._folder(-1)), sum(bytes_in(self.spark, self._folder(x)) for x in range(self.rounds))
        self.apart = texts is not None
        self.most = max(most, self.held if self.apart else 0)  # bytes of states
        if self.apart and self.held <= FEW * self.most:
            self.rounds, self.span = 1, parts
        if self.apart:  # texts and states have the same buckets
            self.states = texts.select("block", F.col("pack").alias("texts")).hint("merge").join(self.states.select("block", "kind", "pack"), "block")
            self.asked = self.table.where("kind = 'state'").count()  # the blocks that ask

    def _folder(self, asks: int) -> str:
        return f"{self.path}/asks={asks}"

    def asks(self, x: int) -> DataFrame:
        """The asks of a round."""
        if not self.apart:
            return self.table.where(F.col("asks") == x).drop("asks")
        made = _asking(self.parts, self.k, self.length, x * self.span, min(self.span, self.parts - x * self.span))
        return self.states.where("kind = 'state'").select("block", "texts", "pack").mapInArrow(made, _PACKS)

    def answered(self) -> list[DataFrame]:
        """The answers, written round by round; the asks go."""
        out = []
        for x in range(-(-self.parts // self.span) if self.asked else 0):
            own = self.asks(x).repartitionById(self.span, (F.col("part") - x * self.span).cast("int"))
            out.append(written(own.mapInArrow(_totals, _PACKS), "answers"))
            deleted(self.spark, self._folder(x))
        return out


def lm_scores(docs: DataFrame, held_out) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``held_out``: a boolean column of rows that are scored but not learnt from; null counts as
    false. ``base_score``: sum over words and one end of ``log10((c + 0.1) / (N + 0.1 * (V + 1)))``;
    ``score``: the suffix tree's log10 probability of the same symbols. Words are compared by 64-bit
    hashes. Null texts are empty: one token, the end. Repeated rows each count. Very long texts are
    blocks of their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), held)
    kind = dict(rows.dtypes)["doc_id"]
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # unknown
    parts = max(shuffle_partitions(spark), size // PART_BYTES)
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, size // BLOCK_BYTES + 1))
    most, least = parts, min(parts, spark.sparkContext.defaultParallelism)
    step = first = _Step(rows.mapInArrow(_begun(parts), _PACKS), parts, parts, -1, 0)
    k, length = 0, 0
    while step.asked or step.apart:
        told = step.answered()
        answers = spark.read.schema(_PACKS).parquet(*[x._table_path for x in told]) if told else spark.createDataFrame([], _PACKS)
        if not told:  # no block asks, but states are to be whole
            k = max(k, WHOLE)
        if k > WHOLE:  # from here on less is asked and held from step to step
            parts = min(parts, max(least, step.asked // PACK_BYTES))
        then = step.states.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_step(parts, k, length), _PACKS)
        fewer = min(most, max(least, step.held // PACK_BYTES)) if k > WHOLE else most
        before, step = step, _Step(then, fewer, parts, k, length, first.states if k < WHOLE else None, step.most)
        if before is not first:
            deleted_table(before.table)
        if before.apart and not step.apart:
            deleted_table(first.table)
        dropped(*told)
        k, length = k + 1, longer(length) if k else 1
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    spark.sql(f"DROP TABLE {step.table._table_name}")  # its files stay for the result
    if not step.held:  # an empty table has no folder of states
        return spark.createDataFrame([], schema)
    return spark.read.schema(_PACKS).parquet(f"{step.path}/asks=-1").select("pack").mapInArrow(_told(), schema)
