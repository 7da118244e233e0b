"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it.

*Nodes* are distinct vectors (64-bit hash), so a vector that a third of the rows repeat is one
node; of its rows only the smallest ids can be in an answer, and these are looked up at the end.

*Start.* Random-projection trees: nodes are dealt by range of a random projection, split on within
a partition down to leaves, and each leaf is compared in full.

*NN-descent.* In a round, every node takes its neighbours and the best nodes that have it as a
neighbour, and proposes all of them to each other. The join is made for a partition of nodes at a
time: a vector that several of its nodes need is sent there once. Proposals that beat a node's last
neighbour are merged into its list. Rounds end when few lists change.

*Search.* A query is a beam of nodes. Each hop opens its best unopened nodes, joins their lists and
then the vectors of nodes it has not scored, and keeps the best. Queries are handled in blocks of a
bounded number, against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from feedloom.llm.runtime import dropped, written

K = 40
TREES = 6
LEAF = 1500
#: Nodes that one task holds at a time, about: at most 2 * K vectors come with each.
BLOCK_NODES = 6000
BLOCK_QUERIES = 1000
ROUNDS = 6
#: NN-descent ends when a round changes fewer than this share of all list entries.
FEW = 0.01
BEAM = 160
OPENED = 24
HOPS = 6

_LISTS = "node long, ids array<long>, scores array<float>"


def _matrix(column, width: int | None = None) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width or -1) if len(column) else flat.reshape(0, width or 1)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best distinct others of each owner, by owner, best first, ties to the smaller id."""
    order = np.lexsort((other, owner))
    owner, other, score = owner[order], other[order], score[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score = owner[fresh], other[fresh], score[fresh]
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner[rank < k], other[rank < k], score[rank < k]


def _packed(owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    nodes, counts = np.unique(owner, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), _lists(other, counts, pa.int64()), _lists(score.astype(np.float32), counts, pa.float32())],
        names=["node", "ids", "scores"],
    )


def _leaves(index: np.ndarray, vectors: np.ndarray, random: np.random.Generator) -> Iterator[np.ndarray]:
    if len(index) <= LEAF:
        yield index
        return
    side = vectors[index] @ random.standard_normal(vectors.shape[1]).astype(np.float32)
    order = np.argsort(side, kind="stable")
    for half in np.array_split(order, 2):
        yield from _leaves(index[half], vectors, random)


def _projected(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            for t in range(trees if batch.num_rows else 0):
                line = np.random.default_rng(t).standard_normal(vectors.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(vectors @ line), batch.column("node"), batch.column("vec")],
                    names=["tree", "at", "node", "vec"],
                )

    return run


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of each node within its leaf."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    tree, node, vectors = table.column("tree").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("vec"))
    for t in np.unique(tree):
        for leaf in _leaves(np.flatnonzero(tree == t), vectors, np.random.default_rng(1000 + t)):
            score = vectors[leaf] @ vectors[leaf].T
            np.fill_diagonal(score, -np.inf)
            k = min(K, len(leaf) - 1)
            if k < 1:
                continue
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            yield _packed(*_best(np.repeat(node[leaf], k), node[leaf][top].ravel(), np.take_along_axis(score, top, 1).ravel(), k))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list for each node of the partition: the best of all that came."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    ids, scores = table.column("ids").combine_chunks(), table.column("scores").combine_chunks()
    owner = np.repeat(table.column("node").to_numpy(), ids.value_lengths().to_numpy())
    yield _packed(*_best(owner, ids.flatten().to_numpy(), scores.flatten().to_numpy(), K))


def _proposed(parts: int):
    """From a part's nodes with the lists around them, and the vectors of these, to proposals.

    They are packed by the part that they go to.
    """

    def run(left, right):
        owner, other, score = _proposals(left, right) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 3
        goal = np.mod(owner, parts)
        order = np.argsort(goal, kind="stable")
        goals, counts = np.unique(goal, return_counts=True)
        return pa.table(
            {
                "goal": pa.array(goals, pa.int32()),
                "nodes": _lists(owner[order], counts, pa.int64()),
                "ids": _lists(other[order], counts, pa.int64()),
                "scores": _lists(score[order].astype(np.float32), counts, pa.float32()),
            }
        )

    return run


def _improved(left, right):
    """A part's lists after the proposals to it."""
    lists = left.column("ids").combine_chunks()
    owner = np.repeat(left.column("node").to_numpy(), lists.value_lengths().to_numpy())
    flat = lambda table, c: table.column(c).combine_chunks().flatten().to_numpy()
    rows = [(owner, flat(left, "ids"), flat(left, "scores"))]
    if right.num_rows:
        rows.append(tuple(flat(right, c) for c in ("nodes", "ids", "scores")))
    return pa.Table.from_batches([_packed(*_best(*(np.concatenate(x) for x in zip(*rows, strict=True)), K))])


def _proposals(left, right):
    known = right.column("node").to_numpy()
    order = np.argsort(known)
    known, vectors, least = known[order], _matrix(right.column("vec"))[order], right.column("least").to_numpy()[order]
    around = left.column("around").combine_chunks()
    counts = around.value_lengths().to_numpy()
    flat = np.searchsorted(known, around.flatten().to_numpy())
    starts = np.concatenate([[0], np.cumsum(counts)])
    width = int(counts.max())
    found: list[tuple] = []
    held = 0

    def squeezed():
        return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), K)

    for a in range(0, len(counts), 256):
        size = counts[a : a + 256]
        at = np.full((len(size), width), -1)
        at[np.arange(width) < size[:, None]] = flat[starts[a] : starts[min(a + 256, len(counts))]]
        some = vectors[at]
        score = some @ some.transpose(0, 2, 1)
        live = (at >= 0)[:, :, None] & (at >= 0)[:, None, :] & (at[:, :, None] != at[:, None, :])
        row, i, j = np.nonzero(live & (score > least[at][:, :, None]))
        found.append((known[at[row, i]], known[at[row, j]], score[row, i, j]))
        held += len(row)
        if held > 2_000_000:
            found = [squeezed()]
            held = len(found[0][0])
    return squeezed()


def _beamed(exact: bool):
    """Score the candidates of each query, and keep its beam."""

    def run(left, right):
        known = right.column("node").to_numpy() if right.num_rows else np.zeros(0, np.int64)
        order = np.argsort(known)
        kind = np.float64 if exact else np.float32
        vectors = _matrix(right.column("vec"))[order].astype(kind) if right.num_rows else None
        known = known[order]
        out: dict[str, list] = {"part": [], "query": [], "vec": [], "ids": [], "scores": [], "opened": []}
        for row in range(left.num_rows):
            vec = left.column("vec")[row].values.to_numpy()
            ids, scores = left.column("ids")[row].values.to_numpy(), left.column("scores")[row].values.to_numpy()
            opened = left.column("opened")[row].values.to_numpy()
            new = left.column("new")[row].values
            new = np.setdiff1d(new.to_numpy() if new is not None else np.zeros(0, np.int64), ids)
            if len(new):
                new_scores = vectors[np.searchsorted(known, new)] @ vec.astype(kind)
                ids, scores = np.concatenate([ids, new]), np.concatenate([scores, new_scores])
                top = np.lexsort((ids, -scores))[:BEAM]
                ids, scores = ids[top], scores[top]
            for name, value in zip(out, (left.column("part")[row].as_py(), left.column("query")[row].as_py(), vec, ids, scores, opened), strict=True):
                out[name].append(value)
        lists = {"vec": pa.float64() if exact else pa.float32(), "ids": pa.int64(), "scores": pa.float64(), "opened": pa.int64()}
        return pa.table(
            {
                n: _lists(np.concatenate(v) if v else np.zeros(0), np.array([len(x) for x in v], np.int64), lists[n]) if n in lists else pa.array(v, pa.int32() if n == "part" else pa.int64())
                for n, v in out.items()
            }
        )

    return run


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, exact, vec`` of the rows that take part, an id once: the vector as doubles, and as floats for the search.

    Out are null ids, vectors that are null, empty, zero or hold a null or a non-finite number, and
    those whose length isn't the most frequent one (of equals, the smallest), as there is no inner product with
    them. Of several vectors with one id the smallest takes part.
    """
    own = rows.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = own.where("vec_id is not null and vec is not null and size(vec) > 0")
    own = own.where(~F.exists("vec", odd)).where(F.exists("vec", lambda x: x != 0))
    own = own.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    size = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = own.where(F.size("vec") == (size.n if size else 0))
    return own.select("vec_id", F.col("vec").alias("exact"), F.col("vec").cast("array<float>").alias("vec"))


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """``node, ids, scores`` for ``nodes(node, vec)``: near-best neighbours of each, best first."""
    n = nodes.count()
    parts = max(8, -(-n // BLOCK_NODES))
    dealt = nodes.mapInArrow(_projected(TREES), "tree int, at double, node long, vec array<float>")
    start = dealt.repartitionByRange(max(TREES, -(-n * TREES // (5 * BLOCK_NODES))), "tree", "at").mapInArrow(_started, _LISTS)
    graph = written(start.repartition(parts, "node").mapInArrow(_merged, _LISTS), "graph")
    for _ in range(ROUNDS):
        edges = graph.select("node", F.posexplode("ids").alias("i", "to"), F.col("scores").alias("s")).select("node", "to", F.col("s")[F.col("i")].alias("score"))
        rank = Window.partitionBy("to").orderBy(F.desc("score"), "node")
        back = edges.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= K).select(F.col("to").alias("node"), F.col("node").alias("to"))
        around = edges.select("node", "to").union(back).groupBy("node").agg(F.collect_set("to").alias("around"))
        around = written(around.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")), "around")
        needed = around.select(F.col("part").alias("goal"), F.explode("around").alias("node")).distinct()
        least = graph.select("node", F.when(F.size("scores") < K, F.lit(float("-inf")).cast("float")).otherwise(F.element_at("scores", -1)).alias("least"))
        sent = needed.join(nodes.join(least, "node"), "node").select("goal", "node", "vec", "least")
        packs = "goal int, nodes array<long>, ids array<long>, scores array<float>"
        new = written(around.groupBy("part").cogroup(sent.groupBy("goal")).applyInArrow(_proposed(parts), packs), "new")
        placed = graph.withColumn("part", F.pmod("node", F.lit(parts)).cast("int"))
        merged = written(placed.groupBy("part").cogroup(new.groupBy("goal")).applyInArrow(_improved, _LISTS), "graph")
        changed = merged.join(graph.select("node", F.col("ids").alias("old")), "node").agg(F.sum(F.size(F.array_except("ids", "old")))).first()[0] or 0
        for old in (graph, around, new):
            dropped(old)
        graph = merged
        if changed <= FEW * n * K:
            break
    return graph


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """``query, ids, scores`` for the nodes in ``queries(query, vec)``: the beam after ``HOPS`` hops.

    ``nodes(node, vec, exact)``: the search compares floats, the last beam is scored with the doubles.
    """
    parts = -(-queries.count() // BLOCK_QUERIES) or 1
    beam = queries.join(graph.withColumnRenamed("node", "query"), "query", "left").select(
        F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"),
        "query",
        "vec",
        F.concat(F.array("query"), F.coalesce("ids", F.array().cast("array<long>"))).alias("ids"),
        F.concat(F.array(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), F.coalesce("scores", F.array().cast("array<float>")).cast("array<double>")).alias("scores"),
        F.array("query").alias("opened"),
    )
    beam = written(beam, "beam")
    schema = beam.schema
    for hop in range(HOPS + 1):
        last = hop == HOPS
        if last:  # all scores anew, in double precision
            whole = nodes.select(F.col("node").alias("query"), F.col("exact").alias("vec"))
            candidates = beam.drop("vec").join(whole, "query").select("part", "query", "vec", F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("scores"), "opened", F.col("ids").alias("new"))
        else:
            nexts = F.slice(F.filter("ids", lambda x: ~F.array_contains("opened", x)), 1, OPENED)
            opening = written(beam.withColumn("next", nexts), "opening")
            near = opening.select("query", F.explode("next").alias("node")).join(graph.select("node", F.col("ids").alias("around")), "node")
            near = near.select("query", F.explode("around").alias("b")).groupBy("query").agg(F.collect_set("b").alias("new"))
            candidates = opening.join(near, "query", "left").select(
                "part", "query", "vec", "ids", "scores", F.concat("opened", "next").alias("opened"), F.coalesce("new", F.array().cast("array<long>")).alias("new")
            )
        candidates = written(candidates, "candidates")
        needed = candidates.select(F.col("part").alias("goal"), F.explode(F.array_except("new", "ids")).alias("node")).distinct()
        sent = needed.join(nodes, "node").select("goal", "node", F.col("exact" if last else "vec").alias("vec"))
        out = StructType([StructField(f.name, ArrayType(DoubleType())) if last and f.name == "vec" else f for f in schema])
        after = written(candidates.groupBy("part").cogroup(sent.groupBy("goal")).applyInArrow(_beamed(last), out), "beam")
        dropped(candidates, *([] if last else [opening]))
        dropped(beam)
        beam = after
    return beam.select("query", "ids", "scores")


def nearest(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query row.

    ``rows(vec_id, embedding)``; ``is_query``: a condition on ``vec_id``. Nearness is the inner
    product in double precision; ties go to the smaller id; a row is no neighbour of itself. For
    what takes part see :func:`valid_vectors`. An empty table gives an empty result.
    """
    own = written(valid_vectors(rows).withColumn("node", F.xxhash64("exact")), "vectors")
    first = own.groupBy("node").agg(F.min("vec_id").alias("vec_id"))
    nodes = written(own.join(first, ["node", "vec_id"]).select("node", "vec", "exact"), "nodes")
    order = Window.partitionBy("node").orderBy("vec_id")
    members = own.select("node", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("node", "vec_id")
    asked = own.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    queries = nodes.join(asked.select(F.col("query").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "query")
    graph = neighbour_graph(nodes.select("node", "vec"))
    beam = greedy_search(queries.select("query", "vec"), nodes, graph)
    dropped(nodes, graph)
    found = beam.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("node"), F.col("x.scores").alias("score"))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.join(members, "node").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).select("query", "vec_id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.join(best, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", "score")
