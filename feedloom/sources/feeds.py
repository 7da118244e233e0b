"""Feed items: XML files or texts to rows, filtered, capped and deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedloom.functions.ids import arxiv_id, author_of_description, feed_description
from feedloom.functions.text import clean_text, nonempty, trimmed
from feedloom.operators.joins import not_stored
from feedloom.operators.store import first_wins

ITEM = StructType([StructField(n, StringType()) for n in ("title", "link", "description", "dc:creator")])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Raw items of RSS files, with the file they came from."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return items.withColumn("file", F.col("_metadata.file_name"))


def items_of_texts(texts: DataFrame, xml: str = "body") -> DataFrame:
    """Raw items of whole feeds held in a column."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))
    pieces = texts.select("*", F.posexplode(found).alias("pos", "item"))
    tag = lambda t: trimmed(F.regexp_extract("item", rf"(?s)<{t}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>", 1))
    return pieces.select(*[c for c in texts.columns if c != xml], "pos", *[tag(f.name).alias(f.name) for f in ITEM])


def parsed(items: DataFrame, category: str) -> DataFrame:
    """``id, title, link, abstract, author, category, announce``: items without an id are dropped.

    Only items announced as new or cross-listed stay. Empty texts become null. The link is the canonical one of
    the id; the place ``pos`` in the feed stays if there is one.
    """
    about = feed_description(F.col("description"))
    id_ = F.coalesce(nonempty(arxiv_id(F.col("link"))), nonempty(arxiv_id(F.col("title"))))
    author = F.coalesce(nonempty(trimmed(F.col("`dc:creator`"))), nonempty(author_of_description(F.col("description"))))
    rows = items.select(
        id_.alias("id"),
        clean_text(F.col("title")).alias("title"),
        F.concat(F.lit("https://arxiv.org/abs/"), id_).alias("link"),
        nonempty(clean_text(about["abstract"])).alias("abstract"),
        nonempty(clean_text(author)).alias("author"),
        F.lit(category).alias("category"),
        about["announce"].alias("announce"),
        *([F.col("pos")] if "pos" in items.columns else []),
    )
    return rows.where(F.col("id").isNotNull() & F.col("announce").isin("new", "cross"))


def fetched(feeds: list[DataFrame], stored: DataFrame, most: int = 100) -> DataFrame:
    """New rows of several parsed feeds: the first of each feed (by ``pos``, else by id), the first feed wins, stored ids go."""
    capped = None
    for i, feed in enumerate(feeds):
        rank = F.row_number().over(Window.partitionBy("category").orderBy(*[c for c in ("pos", "id") if c in feed.columns]))
        rows = feed.withColumn("_r", rank).drop("pos").where(F.col("_r") <= most).withColumn("_feed", F.lit(i))
        capped = rows if capped is None else capped.unionByName(rows)
    return not_stored(first_wins(capped, ["id"], [F.col("_feed"), F.col("_r")]), stored).drop("_feed", "_r")
