"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Nodes are numbered within their group by a range sort and the sizes of its parts. Aligned blocks of
``RUN ** HEIGHT`` nodes are each traversed recursively in postorder: the traversal returns the digest of the
subtree and appends to the contained leaves their siblings while it unwinds. The roots of the blocks are the
nodes of the next round, until each group has one; the roots of the groups are dealt with alike. Proofs are
not stored: a second pass from the top down traverses each block again and hands its leaves their own siblings
and those of the block's root. So a task holds one block at a time, however large a group is.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.runtime import shuffle_partitions, written

#: Nodes whose digests make one of the next level.
RUN = 16
#: Levels of a block: it has up to ``RUN ** HEIGHT`` nodes.
HEIGHT = 2

_PATH = "array<struct<left string, right string>>"


def leaf_digest(*columns: Column) -> Column:
    """The SHA-256 of the values one after the other: UTF-8 length, a colon and the value, or ``-`` for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def traversed(digests: list[str], height: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of the subtree of ``height`` levels, and for each leaf its siblings, left and right joined,
    lowest level first."""
    if height == 0:
        return digests[0], [[]]
    width = RUN ** (height - 1)
    below = [traversed(digests[i : i + width], height - 1) for i in range(0, len(digests), width)]
    run, paths = [digest for digest, _ in below], []
    for i, (_, leaves) in enumerate(below):
        siblings = "".join(run[:i]), "".join(run[i + 1 :])
        for path in leaves:
            path.append(siblings)
        paths += leaves
    return hashlib.sha256("".join(run).encode()).hexdigest(), paths


def _levels(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def _placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``gid``, ``n`` and ``place``: the number of the group, its size and the place in it from 0, all
    from one sorted table; and ``group, gid, n`` once each."""
    spark = rows.sparkSession
    by = [group, *order]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = written(ordered.withColumns({"part": F.spark_partition_id(), "at": within}), "leaves")
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = list(zip((part for part, _ in sizes), accumulate([0, *(n for _, n in sizes)]), strict=False))
    starts = spark.createDataFrame(before, "part int, before long")
    table = table.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.col("before")).drop("part", "before")
    known = written(table.groupBy(group).agg(F.min("at").alias("gid"), F.count(F.lit(1)).alias("n")), "groups")
    met = table.join(known.withColumnRenamed(group, "own"), F.col(group).eqNullSafe(F.col("own"))).drop("own")
    return met.withColumn("place", F.col("at") - F.col("gid")).drop("at"), known


def _blocks(nodes: DataFrame, height: int, *more: str):
    """``nodes`` grouped by aligned blocks."""
    bits = (RUN**height - 1).bit_length()
    return nodes.select("gid", "n", "place", "digest", *more, F.shiftright("place", bits).alias("block")).groupBy("gid", "block")


def _rounds(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """Tables ``gid, n, place, digest`` of the nodes of each round; in the last each group has one."""
    width = RUN**height

    def root(key: tuple, block: pa.Table) -> pa.Table:
        n = block["n"][0].as_py()
        digest, _ = traversed(block.sort_by("place")["digest"].to_pylist(), min(height, _levels(n)))
        return pa.table({"gid": [key[0].as_py()], "n": [-(-n // width)], "place": [key[1].as_py()], "digest": [digest]})

    out = [nodes]
    for _ in range(max(1, -(-_levels(most) // height))):
        out.append(written(_blocks(out[-1], height).applyInArrow(root, "gid long, n long, place long, digest string"), "roots"))
    return out


def _with_paths(rounds: list[DataFrame], top: DataFrame, row: str, height: int) -> DataFrame:
    """``gid, place, digest, row, path, subroot`` of the nodes of the first round.

    ``top(gid, path, subroot)`` has the paths of the groups' roots; ``row`` is the type of that column.
    """

    def descended(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        _, own = traversed(block["digest"].to_pylist(), min(height, _levels(block["n"][0].as_py())))
        upper = [(s["left"], s["right"]) for s in above["path"][0].as_py()]
        steps = [step for path in own for step in (*path, *upper)]
        ends = np.cumsum([0, *(len(path) + len(upper) for path in own)])
        pairs = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.string()) for i in range(2)], names=["left", "right"])
        out = block.drop_columns(["n", "block"]).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
        return out.append_column("subroot", pa.array([above["subroot"][0].as_py()] * len(block), pa.string()))

    paths = top.withColumn("place", F.lit(0).cast("long"))
    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        carried = ["row"] if i == 0 else []
        upper = paths.select(F.col("gid").alias("gid"), F.col("place").alias("block"), "path", "subroot").groupBy("gid", "block")
        schema = f"gid long, place long, digest string, {f'row {row}, ' if carried else ''}path {_PATH}, subroot string"
        paths = _blocks(nodes, height, *carried).cogroup(upper).applyInArrow(descended, schema)
    return paths


def manifest(leaves: DataFrame, group: str, order: list[str], digest: str = "leaf", height: int = HEIGHT) -> DataFrame:
    """``leaves`` with ``subroot`` of its group, ``root`` and ``proof``: an array of ``left, right``, the siblings of
    the leaf and of each node above it, from the run of the leaf to the root, as joined digests.

    The leaves of a group ascend by ``order`` (nulls first), ties by digest; groups ascend, null first, which is
    a group like any other. Every ``RUN`` consecutive nodes (the last run may have fewer, even one) become the
    SHA-256 of their joined digests while a group has more than one node, and so do the groups' roots. A lone
    leaf is its group's root, a lone group's root the root; then the proof is empty.

    Rows that repeat are leaves of their own. An empty table has no rows and no root. Columns of ``leaves`` named
    ``subroot``, ``root`` or ``proof`` are replaced. The digest must not be null. Texts take no part: select the
    columns that the result needs.
    """
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = leaves.select(row.alias("row"), F.col(group).alias("grp"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)], F.col(digest).alias("digest"))
    nodes, known = _placed(rows, "grp", [*[f"by{i}" for i in range(len(order))], "digest"])
    most = known.agg(F.max("n")).first()[0]
    if most is None:
        return leaves.select(*kept, F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_PATH).alias("proof"))
    rounds = _rounds(nodes, most, height)

    subroots = rounds[-1].select("gid", "digest").join(known.select("gid", "grp"), "gid")
    tops = subroots.select(F.struct("gid", "digest").alias("row"), F.lit(0).alias("all"), "grp", "digest")
    tops, every = _placed(tops, "all", ["grp"])
    upper = _rounds(tops, every.first()["n"], height)
    root = upper[-1].first()["digest"]
    nothing = every.select("gid", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    paths = _with_paths(upper, nothing, dict(tops.dtypes)["row"], height).select("row.gid", "path", F.col("row.digest").alias("subroot"))

    out = _with_paths(rounds, paths, dict(nodes.dtypes)["row"], height)
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "subroot", F.lit(root).alias("root"), F.col("path").alias("proof"))


def folded(digest: Column, proof: Column) -> Column:
    """The root that ``digest`` and its siblings lead to."""
    return F.aggregate(proof, digest, lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The SHA-256 of all siblings, joined."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)
