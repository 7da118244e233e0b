"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

A document is the set of its distinct ``width``-word shingles; two link when
``100 * |A and B| >= percent * |A or B|``. Shingles are 64-bit hashes, and the global order is
their numeric order, so every range of it holds about the same share of any set.

1. *Fragments.* For the size class of the larger set of a pair, the order is cut into
   ``F = k + z + m`` ranges. Linked sets differ by at most ``k`` shingles, each spoiling one
   fragment, so at least ``z + m`` fragments are equal. A fragment of common shingles only is
   weak; a set with at most ``z`` weak ones need not sign them, as ``m`` equal ones remain. No link
   is lost, and a passage that many documents share makes few candidates. Common are shingles whose
   counter, in a sketch of fixed size over all documents, is far over the mean.
2. *Candidates.* A fragment's hash is a signature. Signatures travel as packed blocks, once; the
   receiving task keeps those that two different sets share. A set that shares fewer than ``m``
   signatures of a class with others has no link in it.
3. *Partial overlaps.* Every signature has a pivot, a set that shares many signatures with others
   of its members. A set is compared with its pivots: both are cut into ``GROUPS`` fragments of the order,
   joined and compared fragment by fragment, and the partial results summed for each pair. What
   remains is the difference ``D`` of a set to its pivot.
4. *Groups.* Equal sets are one node from the start. Two sets with the same pivot link when
   ``|Dx| + |Dy| - 2 |Dx and Dy|`` is small. If they share no difference, both link to the pivot.
   Else the numbers of what the pivot lacks and of what only the pivot has bound how many of the former
   (or, where none is needed, of the latter) the two must share, so a prefix join finds all that is
   left. Its order is the rarest first in the group: an edit that one copy has alone makes no row,
   and a passage that many share comes last.
5. *Stars, then pairs.* First every set of a key is compared with one of them, in linear work, and the
   components are joined. Then keys that still have several components are joined in full, so a group
   of near copies costs rows in proportion to its size and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.llm.runtime import dropped, shuffle_partitions, written
from feedloom.llm.wordhash import SPACED, Words, mix, runs, text_chunks

GROUPS = 4
#: In a group, a difference is common when one of so many members has it; a group has few such differences.
COMMON_SHARE = 4
_SKETCH = 1 << 20
_SKETCH_SHIFT = np.uint64(44)
_SKETCH_PARTS = 16
#: A shingle is common when its counter is over this many, and over this many times the mean.
COMMON_COUNT, COMMON_TIMES = 16, 4
#: A list of ids of up to this many rows (16 bytes each) may be broadcast; a longer one is joined.
BROADCAST_IDS = 1_000_000


@cache
def _classes(limit: int) -> np.ndarray:
    """Lower ends of the size classes, each 1.4 times as wide as the one before, past ``limit``."""
    ends = [1]
    while ends[-1] <= limit:
        ends.append(ends[-1] * 14 // 10 + 1)
    return np.array(ends, dtype=np.int64)


@cache
def _cuts(largest: int, percent: int) -> tuple[int, int, int]:
    """(F, z, m) for pairs whose larger set has at most ``largest`` shingles."""
    k = 2 * largest * (100 - percent) // (100 + percent)
    if k == 0:
        return 0, 0, 0
    need = 1 + k // 8
    share = 0.5 * largest / (k + need)  # rare shingles in a fragment, about
    spare = 1 + math.ceil(1.3 * (k + need) * math.exp(-share))
    return k + need + spare, spare, need


def _signatures(tokens: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """Signatures of one set (its sorted distinct hashes) for every class it can pair in.

    The lowest byte is the class; there are fewer than 80 up to 2**32 shingles.
    """
    n = len(tokens)
    most = n * 100 // percent
    ends = _classes(1 << (most + 1).bit_length())
    c, last = np.searchsorted(ends, [n, most], "right") - 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens))])
    rare = np.concatenate([[0], np.cumsum(~common[tokens >> _SKETCH_SHIFT])])
    top = tokens >> np.uint64(32)
    out = []
    for c in range(c, last + 1):
        pieces, spare, _ = _cuts(int(ends[c + 1]) - 1, percent)
        if not pieces:
            continue
        cell = (top * np.uint64(pieces)) >> np.uint64(32)
        at = np.searchsorted(cell, np.arange(pieces + 1, dtype=np.uint64))
        size = np.diff(at)
        sig = total[at[1:]] - total[at[:-1]] + (np.arange(pieces) * 1_000_003 + c).astype(np.uint64)
        sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)) & ~np.uint64(255) | np.uint64(c)
        weak = rare[at[1:]] == rare[at[:-1]]
        out.append(sig if weak.sum() > spare else sig[~weak])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row with words."""
    for first, _, data, offsets in text_chunks(batch.column("text"), 1 << 19):
        words = Words(data, offsets, SPACED)
        shingles = runs(words.hash, width)
        bounds = words.bounds
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield first + i, np.unique(shingles[a : b - width + 1])
            elif b > a:
                short = words.hash[a:b]
                salted = np.concatenate([np.array([b - a], dtype=np.uint64), short])
                yield first + i, runs(salted, len(salted))


def _node(tokens: np.ndarray) -> int:
    """A 64-bit id of a set; equal sets have equal ids."""
    total = mix(tokens).sum(dtype=np.uint64, keepdims=True)
    total += np.array([len(tokens)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return int(mix(total)[0].astype(np.int64))


def _sized(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            node = np.zeros(batch.num_rows, np.int64)
            for row, tokens in _sets(batch, width):
                size[row], node[row] = len(tokens), _node(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(node, mask=size == 0)],
                names=["doc_id", "n_shingles", "node"],
            )

    return run


def _sketched(width: int):
    """(piece, counters): how many sets of a task fall on each counter, equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SKETCH, np.int64)
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            for _, tokens in _sets(batch, width):
                node = _node(tokens)
                if node in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                held.append((tokens >> _SKETCH_SHIFT).astype(np.int32))
                size += len(tokens)
                if size >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=_SKETCH)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=_SKETCH)
        pieces = [p.astype("<u4").tobytes() for p in np.split(np.minimum(total, 2**32 - 1), _SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SKETCH_PARTS), pa.int32()), pa.array(pieces)], names=["piece", "counters"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counters in zip(batch.column("piece").to_pylist(), batch.column("counters"), strict=True):
            more = np.frombuffer(counters.as_buffer(), "<u4").astype(np.int64)
            total[piece] = total[piece] + more if piece in total else more
    for piece, counters in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([counters.tobytes()])], names=["piece", "counters"])


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Which counters of the sketch are common; its size doesn't depend on the corpus."""
    rows = texts.mapInArrow(_sketched(width), "piece int, counters binary").repartition(_SKETCH_PARTS, "piece")
    counters = np.zeros((_SKETCH_PARTS, _SKETCH // _SKETCH_PARTS), np.int64)
    for r in rows.mapInArrow(_summed, "piece int, counters binary").collect():
        counters[r.piece] = np.frombuffer(r.counters, np.int64)
    return counters.ravel() > max(COMMON_COUNT, COMMON_TIMES * counters.mean())


def _signed(width: int, percent: int, parts: int, common, flush: int = 1 << 19):
    """Packed blocks (part, binary of signatures then nodes); a task signs equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held, seen = 0, set()

        def block() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            part = (sig % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, node, part = sig[order], node[order], part[order]
            keys, at = np.unique(part, return_index=True)
            packs = [
                a.tobytes() + b.tobytes()
                for a, b in zip(np.split(sig, at[1:]), np.split(node, at[1:]), strict=True)
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(packs, pa.binary())], names=["part", "pack"]
            )

        for batch in batches:
            for _, tokens in _sets(batch, width):
                node = _node(tokens)
                if node in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                sig = _signatures(tokens, percent, common.value)
                if len(sig):
                    sigs.append(sig)
                    nodes.append(np.full(len(sig), node, np.int64))
                    held += len(sig)
                if held >= flush:
                    yield block()
                    sigs, nodes, held = [], [], 0
        if held:
            yield block()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node) of the signatures that two nodes share.

    Holds each distinct signature once with the first node that had it; further members of a hot
    signature stream past. The known ones lie in a few sorted runs of doubling size.
    """
    known: list[list[np.ndarray]] = []
    names = ["sig", "node"]

    def emit(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node)], names=names)

    def taken(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal known
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        new = np.ones(len(sig), bool)
        for s, owner, told in known:
            at = np.minimum(np.searchsorted(s, sig), len(s) - 1)
            hit = s[at] == sig
            new &= ~hit
            other = hit & (owner[at] != node)
            if other.any():
                yield emit(sig[other], node[other])
                first = np.unique(at[other])
                first = first[~told[first]]
                told[first] = True
                if len(first):
                    yield emit(s[first], owner[first])
        sig, node = sig[new], node[new]
        if not len(sig):
            return
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        several = ~head
        several[:-1] |= ~head[1:]
        if several.any():
            yield emit(sig[several], node[several])
        known.append([sig[head], node[head], several[head]])
        while len(known) > 1 and len(known[-2][0]) < 2 * len(known[-1][0]):
            b, a = known.pop(), known.pop()
            s = np.concatenate([a[0], b[0]])
            order = np.argsort(s, kind="stable")
            known.append([s[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]])

    sigs, nodes, held = [], [], 0
    for batch in batches:
        for pack in batch.column("pack"):
            raw = pack.as_buffer()
            half = raw.size // 2
            sigs.append(np.frombuffer(raw, np.uint64, half // 8).copy())
            nodes.append(np.frombuffer(raw, np.int64, half // 8, half).copy())
            held += half // 8
            if held >= 1 << 18:
                yield from taken(np.concatenate(sigs), np.concatenate(nodes))
                sigs, nodes, held = [], [], 0
    if held:
        yield from taken(np.concatenate(sigs), np.concatenate(nodes))


def _enough(shared: DataFrame, percent: int) -> DataFrame:
    """``shared`` without sets that share too few signatures of a class, and what then isn't shared."""
    ends = _classes(1 << 33)
    need = F.array(*[F.lit(_cuts(int(e) - 1, percent)[2]) for e in ends[1:]])
    kind = F.col("sig").bitwiseAND(F.lit(255)).cast("int").alias("kind")
    for _ in range(2):
        before, shared = shared, shared.withColumn("kind", kind)
        own = shared.groupBy("node", "kind").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") >= F.get(need, F.col("kind")))
        shared = shared.join(own, ["node", "kind"], "left_semi").select("sig", "node")
        some = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        kept = written(shared.join(some, "sig", "left_semi"), "enough")
        dropped(before)
        shared = kept
    return shared


def _grouped(width: int):
    """(node, n, grp, tokens): a set cut into GROUPS fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def block() -> pa.RecordBatch:
                node, n, grp, tokens = zip(*rows, strict=True)
                lengths = np.array([0, *map(len, tokens)]).cumsum().astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(tokens)))
                return pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(grp, pa.int32()), lists],
                    names=["node", "n", "grp", "tokens"],
                )

            for _, tokens in _sets(batch, width):
                node = _node(tokens)
                cell = (tokens >> np.uint64(62)).astype(np.int64) * GROUPS // 4
                at = np.searchsorted(cell, np.arange(GROUPS + 1))
                for g in range(GROUPS):
                    rows.append((node, len(tokens), g, tokens[at[g] : at[g + 1]].view(np.int64)))
                held += len(tokens)
                if held >= 1 << 19:
                    yield block()
                    rows, held = [], 0
            if rows:
                yield block()

    return run


def _within(difference, sizes, percent: int):
    """Whether sets that differ by ``difference`` shingles of ``sizes`` in all link."""
    return difference * (100 + percent) <= sizes * (100 - percent)


def _differences(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``node, pivot, n, pn, more, less``: the shingles that the pivot lacks, and those that only it has.

    They are made fragment by fragment.
    """
    if pairs.count() <= BROADCAST_IDS:
        pairs = F.broadcast(pairs)
    pivots = tokens.join(pairs.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi")
    right = pivots.select(F.col("node").alias("pivot"), F.col("n").alias("pn"), "grp", F.col("tokens").alias("other"))
    both = tokens.join(pairs, "node").join(right, ["pivot", "grp"])
    cut = both.select(
        "node", "pivot", "n", "pn", F.array_except("tokens", "other").alias("more"), F.array_except("other", "tokens").alias("less")
    )
    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return cut.groupBy("node", "pivot").agg(F.max("n").alias("n"), F.max("pn").alias("pn"), whole("more"), whole("less"))


def _prefixes(differences: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``key, pivot, node, kind, n, m, l, at``: the first differences of a set to its pivot, rarest first.

    ``kind`` 0 are the ``m`` shingles that the pivot lacks, 1 the ``l`` that only the pivot has; ``at`` is the
    place among those of the kind. Only groups of several components and keys that two of them hold are kept.
    What only one component has comes first, then the rest by count; shingles that a ``COMMON_SHARE``-th of the
    group or more have come last and stay in arrays, so they make rows only where a prefix reaches them.
    """
    rows = differences.join(nodes.select("node", "comp"), "node")
    mixed = rows.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
    k = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent)).cast("int")
    rows = rows.join(mixed.select("pivot", "members"), "pivot").withColumn("k", k)
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("more").alias("tokens")),
        F.struct(F.lit(1).alias("kind"), F.when(F.size("more") <= F.col("k"), F.col("less")).otherwise(F.array()).alias("tokens")),
    )
    sizes = ("pivot", "node", "comp", "members", "n", "k", F.size("more").alias("m"), F.size("less").alias("l"))
    sides = written(rows.select(*sizes, F.explode(kinds).alias("x")).select("*", "x.kind", "x.tokens").drop("x"), "sides")

    each = sides.select("pivot", "kind", "comp", "members", F.explode("tokens").alias("token"))
    seen = each.groupBy("pivot", "kind", "token").agg(F.count(F.lit(1)).alias("count"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("members").alias("members"))
    seen = written(seen.where("lo <> hi").select("pivot", "kind", "token", "count", (F.col("count") * COMMON_SHARE >= F.col("members")).alias("common")), "seen")
    common = seen.where("common").groupBy("pivot", "kind").agg(F.sort_array(F.collect_list(F.struct("count", "token")))["token"].alias("common"))
    sides_ = sides.join(common, ["pivot", "kind"], "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    split = sides_.withColumn("last", F.array_intersect("common", "tokens")).withColumn("tokens", F.array_except("tokens", "common")).drop("common")
    rare = split.select("pivot", "kind", "node", F.explode("tokens").alias("token")).join(seen.where("not common").drop("common"), ["pivot", "kind", "token"])
    own = rare.groupBy("pivot", "node", "kind").agg(F.sort_array(F.collect_list(F.struct("count", "token")))["token"].alias("own"))
    both = split.join(own, ["pivot", "node", "kind"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
    both = both.withColumn("alone", F.size("tokens") - F.size("own"))
    both = both.withColumn("own", F.slice(F.concat("own", "last"), 1, F.greatest(F.lit(0), F.col("k") + 1 - F.col("alone"))))
    first = both.select("pivot", "node", "kind", "n", "m", "l", "alone", F.posexplode("own").alias("at", "token"))
    first = first.select(F.xxhash64("pivot", "kind", "token").alias("key"), "pivot", "node", "kind", "n", "m", "l", (F.col("alone") + F.col("at")).alias("at"))
    prefix = written(first, "prefix")
    dropped(sides, seen)
    return prefix


def _may_link(percent: int):
    """Whether two sets of one key (columns of the other end in ``_b``) can link, and this key be the first they share.

    Linked sets share a difference of kind 0, or, where their sizes don't ask for that, one of kind 1.
    """
    over = lambda x, y: (F.col(x) + F.col(f"{x}_b") + F.abs(F.col(y) - F.col(f"{y}_b"))) * (100 + percent) - (F.col("n") + F.col("n_b")) * (100 - percent)
    more, less = over("m", "l"), over("l", "m")
    need = lambda x: F.ceil(x / (2 * (100 + percent)))
    early = lambda own, x: (F.col("at") + need(x) <= F.col(own)) & (F.col("at_b") + need(x) <= F.col(f"{own}_b"))
    first = (F.col("kind") == 0) & (more > 0) & early("m", more)
    return first | (F.col("kind") == 1) & (more <= 0) & (less > 0) & early("l", less)


_OTHER = ("node", "comp", "n", "m", "l", "at")


def _of_components(prefix: DataFrame, nodes: DataFrame) -> DataFrame:
    """``prefix`` with the components of its sets, where a key still has several."""
    rows = prefix.join(nodes.select("node", "comp"), "node")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return written(rows.join(mixed.select("key"), "key", "left_semi"), "mixed")


def _star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b, pivot``: every set of a key with one chosen set of that key, where the two may link."""
    chosen = F.min(F.struct(F.xxhash64("node", "key").alias("h"), *_OTHER)).alias("x")
    star = rows.groupBy("key").agg(chosen).select("key", *[F.col(f"x.{c}").alias(f"{c}_b") for c in _OTHER])
    return _pairs(rows.join(star, "key").where((F.col("comp") != F.col("comp_b")) & _may_link(percent)))


def _near_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b, pivot``: all pairs of different components that share a key and may link."""
    two = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in _OTHER])
    return _pairs(rows.join(two, "key").where((F.col("node") < F.col("node_b")) & (F.col("comp") != F.col("comp_b")) & _may_link(percent)))


def _pairs(found: DataFrame) -> DataFrame:
    ends = found.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), "pivot")
    return ends.groupBy("a", "b").agg(F.min("pivot").alias("pivot"))


def _linked(pairs: DataFrame, differences: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``pairs`` that link, counted on their differences to one pivot."""
    side = lambda x: differences.select("pivot", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "more", "less")])
    both = pairs.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"])
    apart = lambda c: F.size(f"{c}_a") + F.size(f"{c}_b") - 2 * F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
    return both.where(_within(apart("more") + apart("less"), F.col("n_a") + F.col("n_b"), percent)).select("a", "b").distinct()


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes(node, comp)`` after joining components that ``links`` connect; the table of ``nodes`` goes."""
    side = nodes.select("node", "comp")
    across = (
        links.join(side.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
        .join(side.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )
    top = components(across)
    up = top.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    merged = written(nodes.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "nodes")
    dropped(top, nodes)
    return merged


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``component_id`` is the
    smallest ``doc_id`` that links reach. Null, empty and wordless texts have no shingles and are
    alone; a text of fewer than ``width`` words is one shingle. Repeated rows of one ``doc_id``
    stay rows of the result. A row whose ``doc_id`` is null keeps a null id and links as any other; it
    names no component that has another id. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select("doc_id", "text")
    sized = written(texts.mapInArrow(_sized(width), f"doc_id {dict(texts.dtypes)['doc_id']}, n_shingles long, node long"), "sized")
    parts = shuffle_partitions(spark)
    common = spark.sparkContext.broadcast(_common(texts.select("text"), width))
    packs = texts.select("text").mapInArrow(_signed(width, percent, parts, common), "part int, pack binary")
    shared = written(packs.repartition(parts, "part").mapInArrow(_shared, "sig long, node long"), "shared")
    shared = _enough(shared, percent)

    reps = (
        sized.where("node is not null")
        .join(shared.select("node").distinct(), "node", "left_semi")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    )
    reps = written(reps, "reps")
    ids = reps.select("doc_id")
    if reps.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    cut = lambda rows: rows.select("text").mapInArrow(_grouped(width), "node long, n long, grp int, tokens array<long>")
    tokens = cut(texts.join(ids, "doc_id", "left_semi"))
    if sized.join(ids, "doc_id", "left_semi").count() != reps.where("doc_id is not null").count():  # an id of several rows
        tokens = tokens.dropDuplicates(["node", "grp"])
    unnamed = reps.where("doc_id is null").select("node")
    count = unnamed.count()
    if count:  # sets of rows without an id only: no id leads to their texts
        if count <= BROADCAST_IDS:
            unnamed = F.broadcast(unnamed)
        more = cut(texts.where("doc_id is null")).join(unnamed, "node", "left_semi")
        tokens = tokens.unionByName(more.dropDuplicates(["node", "grp"]))
    tokens = written(tokens, "tokens")
    nodes = written(reps.select("node", F.col("node").alias("comp")), "nodes")
    dropped(reps)

    size = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("members"))
    weight = shared.join(size, "sig").groupBy("node").agg(F.sum("members").alias("weight"))
    heavy = shared.join(weight, "node").select("sig", F.struct("weight", "node").alias("top"))
    top = heavy.groupBy("sig").agg(F.max("top").alias("top"))
    home = shared.join(top, "sig").groupBy("node").agg(F.max("top").alias("top"))
    heavy = shared.join(home, "node").select("sig", "top")  # the weightiest that a member shares with any
    pivot = heavy.groupBy("sig").agg(F.max("top")["node"].alias("pivot"))
    pairs = written(shared.join(pivot, "sig").select("node", "pivot").distinct(), "pairs")
    differences = written(_differences(pairs, tokens), "differences")
    direct = differences.where(_within(F.size("more") + F.size("less"), F.col("n") + F.col("pn"), percent))
    nodes = _merged(nodes, direct.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    prefix = _prefixes(differences, nodes, percent)
    for near in (_star_pairs, _near_pairs):
        rows = _of_components(prefix, nodes)
        found = written(near(rows, percent), "near")
        nodes = _merged(nodes, _linked(found, differences, percent))
        dropped(rows, found)
    dropped(shared, tokens, pairs, differences, prefix)

    grouped = sized.where("node is not null").join(nodes.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.groupBy("comp").agg(F.min("doc_id").alias("least"))
    found = grouped.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    wordless = sized.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))  # no key to meet under
    return found.unionByName(wordless)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when one of each group of near duplicates is kept: the smallest id.

    Columns are those of ``docs``. Rows that repeat one id are one document and stay together; so do
    all documents without words, which are no duplicates of each other, and rows with a null id.
    """
    found = jaccard_components(docs, width, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
