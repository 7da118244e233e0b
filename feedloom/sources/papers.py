"""Papers kept as one JSON document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedloom.functions.ids import id_of_abs_url
from feedloom.functions.text import nonempty, paper_ref
from feedloom.operators.store import first_wins
from feedloom.schema import PAPER


def read_papers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All readable documents of a folder with ``file``; unreadable ones are dropped, not raised.

    A file is one document; with ``lines``, as :func:`write_papers` has them, each line is.
    """
    schema = StructType([*PAPER.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path, pathGlobFilter="*.json")
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return upgraded(rows.where("_corrupt_record is null").drop("_corrupt_record"))


def upgraded(papers: DataFrame) -> DataFrame:
    """Documents of older versions with today's columns; nothing is written back.

    A missing arXiv id comes from the source link, missing content and summary from round 0.
    """
    first = lambda role: F.get(F.filter("messages", lambda m: (m["round_number"] == 0) & (m["role"] == role)), 0)["content"]
    return (
        papers.withColumn("arxiv_id", F.coalesce(nonempty(F.col("arxiv_id")), nonempty(id_of_abs_url(F.coalesce("source_url", F.lit("")))), F.lit("")))
        .withColumn("content", F.coalesce(nonempty(F.col("content")), first(F.lit("user")), F.lit("")))
        .withColumn("initial_summary", F.coalesce(nonempty(F.col("initial_summary")), first(F.lit("assistant")), F.lit("")))
        .withColumn("pinned", F.coalesce("pinned", F.lit(False)))
        .withColumn("ref", paper_ref(F.col("session_id"), F.coalesce("id", F.lit(0))))
    )


def listed(papers: DataFrame) -> DataFrame:
    """Summaries, one for each reference (the first file), pinned ones first, then newest."""
    one = first_wins(papers.where("ref <> ''"), ["ref"], [F.col("file")])
    title = F.coalesce(nonempty(F.trim("title")), F.lit("Untitled"))
    rows = one.select("ref", "id", title.alias("title"), "arxiv_id", "source_url", F.coalesce("rating", F.lit(0)).alias("rating"), "pinned", "updated_at", F.size(F.coalesce("messages", F.array())).alias("n_messages"))
    return rows.orderBy(F.desc("pinned"), F.desc("updated_at"), "id", "ref")


def messages_of(papers: DataFrame) -> DataFrame:
    """``paper, seq, round, ...`` of all messages: the place in the array is the order."""
    rows = papers.select(F.col("ref").alias("paper"), F.posexplode("messages").alias("seq", "m")).select("paper", "seq", "m.*")
    return rows.withColumnRenamed("round_number", "round").withColumn("skip_context", F.coalesce("skip_context", F.lit(False)))


def as_chat_papers(papers: DataFrame) -> DataFrame:
    """Rows for the relational store; papers without an arXiv id are left out. A paper without a title is named by its
    reference."""
    minute = lambda c: F.substring(F.regexp_replace(c, "T", " "), 1, 16)
    rows = first_wins(papers.where("arxiv_id <> '' and ref <> ''"), ["ref"], [F.col("file")])
    return rows.select(
        F.col("ref").alias("id"), "arxiv_id", F.coalesce(nonempty(F.col("title")), F.concat(F.lit("Paper "), "ref")).alias("title"), F.coalesce("rating", F.lit(0)).alias("rating"), "source_url", "github_url", minute("created_at").alias("created_at"), minute("updated_at").alias("updated_at")
    )


def write_papers(papers: DataFrame, path: str) -> None:
    """One line of JSON each, without what reading rebuilds from round 0."""
    papers.drop("content", "initial_summary", "file", "ref").write.mode("overwrite").json(path)
