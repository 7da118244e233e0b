"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.runtime import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links(a, b)``: ``comp`` is one node of its component.

    Each round hooks every node onto the neighbour of smallest salted hash, follows that pointer
    twice and contracts the links. A third or more of the nodes go each round, whatever the shape
    of the graph, and only minima are aggregated, so a node with very many links is no hot group.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct(), "links")
    comp = written(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")),
        "comp",
    )
    salt = 0
    while not edges.isEmpty():
        salt += 1
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("id"))
        both = edges.select(F.col("a").alias("node"), rank("b").alias("to")).union(
            edges.select(F.col("b").alias("node"), rank("a").alias("to"))
        )
        hooked = both.groupBy("node").agg(F.min("to").alias("to"))
        hooked = hooked.select("node", F.least(rank("node"), F.col("to"))["id"].alias("up"))
        hooked = written(hooked, "hook")
        top = written(
            hooked.alias("x")
            .join(hooked.alias("y"), F.col("x.up") == F.col("y.node"))
            .select(F.col("x.node"), F.col("y.up").alias("up")),
            "top",
        )
        new_edges = written(
            edges.join(top.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
            .join(top.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct(),
            "links",
        )
        new_comp = written(
            comp.join(top.select(F.col("node").alias("comp"), "up"), "comp", "left").select(
                "node", F.coalesce("up", "comp").alias("comp")
            ),
            "comp",
        )
        dropped(edges, hooked, top, comp)
        edges, comp = new_edges, new_comp
    dropped(edges)
    return comp
