"""Daily recommendation: feedback, selection, batches and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.store import clear_recommendations
from feedloom.tables import materialized


def slots(count: int, ratio: float) -> tuple[int, int]:
    """(by score, to explore). A ratio under 0 counts as 0, one over 1 as 0.3."""
    ratio = 0.0 if ratio < 0 else 0.3 if ratio > 1 else ratio
    scored = int(count * (1 - ratio))
    return scored, count - scored


def hybrid_topk(articles: DataFrame, count: int, ratio: float, seed: str) -> DataFrame:
    """``id, recommendation_type, batch_order`` of at most ``count`` rows.

    The pool is unread, not disliked by score, and not yet recommended. The first slots go by
    score, then newest, then id; the others, and slots that lack rows, go to the rest of the pool
    by ``md5(seed|id)``. Both picks are top-k plans; only the picked rows are numbered.
    """
    scored, _ = slots(count, ratio)
    pool = articles.where("status = 0 and score >= 0 and recommend_date is null")
    by_score = pool.orderBy(F.desc("score"), F.desc("created_at"), "id").limit(scored)
    first = by_score.select("id", F.lit("score").alias("recommendation_type"), F.col("score").alias("_s"), F.col("created_at").alias("_c"))
    rest = pool.select("id").join(first.select("id"), "id", "left_anti")
    shuffled = rest.select("id", F.md5(F.concat(F.lit(f"{seed}|"), F.col("id"))).alias("_m")).orderBy("_m", "id").limit(count)
    picked = first.select("id", "recommendation_type", F.lit(0).alias("_p"), "_s", "_c", F.lit(None).cast("string").alias("_m")).unionByName(
        shuffled.select("id", F.lit("random").alias("recommendation_type"), F.lit(1).alias("_p"), F.lit(None).cast("double").alias("_s"), F.lit(None).cast("timestamp").alias("_c"), "_m")
    )
    order = Window.orderBy("_p", F.desc("_s"), F.desc("_c"), "_m", "id")
    return picked.withColumn("batch_order", F.row_number().over(order) - 1).where(F.col("batch_order") < count).select("id", "recommendation_type", "batch_order")


def mark_daily(articles: DataFrame, date: Column, count: int, ratio: float, seed: str) -> DataFrame:
    """The next version of the table: the date's old picks cleared, the new ones marked."""
    base = clear_recommendations(articles, date)
    picks = hybrid_topk(base, count, ratio, seed).select("id", F.col("recommendation_type").alias("_t"), F.col("batch_order").alias("_o"))
    out = base.join(picks, "id", "left")
    out = out.withColumn("recommend_date", F.when(F.col("_t").isNotNull(), date).otherwise(F.col("recommend_date")))
    out = out.withColumn("recommendation_type", F.coalesce("_t", "recommendation_type")).withColumn("batch_order", F.coalesce("_o", "batch_order"))
    return out.select(*articles.columns)


def feedback(articles: DataFrame, papers: DataFrame, since: str, most: int = 200, articles_since: Column | None = None) -> DataFrame:
    """``id, title, abstract, status, source, rating``: what a reader activated, liked or disliked.

    Of each status the best ``most`` articles (whatever their date, unless ``articles_since``), and
    all papers updated since ``since``.
    """
    own = articles.where(F.col("status").isin(1, 2, -1))
    if articles_since is not None:
        own = own.where(F.col("created_at") >= articles_since)
    rank = Window.partitionBy("status").orderBy(F.desc("score"), F.desc("created_at"), "id")
    own = own.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most)
    left = own.select("id", "title", "abstract", "status", F.lit("article").alias("source"), F.lit(0).alias("rating"))
    right = papers.where((F.col("updated_at") >= since) & (F.coalesce("arxiv_id", F.lit("")) != ""))
    right = right.select(F.col("arxiv_id").alias("id"), "title", F.coalesce("abstract", F.lit("")).alias("abstract"), F.lit(1).alias("status"), F.lit("chat").alias("source"), "rating")
    return left.unionByName(right)


def feedback_label(status: Column, source: Column, rating: Column) -> Column:
    return (
        F.when((source == "chat") & (rating > 0), F.concat(F.lit("read in depth, rated "), rating.cast("string"), F.lit("/10")))
        .when(source == "chat", F.lit("read in depth"))
        .when(status == 2, F.lit("liked"))
        .when(status == -1, F.lit("disliked"))
        .when(status == 1, F.lit("activated"))
        .otherwise(F.lit("seen"))
    )


def in_batches(rows: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """``rows`` with ``batch``, ``pos``: a global order without one task numbering all rows.

    Rows are sorted over partitions; each partition's offset comes from the counts of those before. The
    sorted rows are written once: sorted anew, they might be cut into other partitions than were counted.
    """
    ordered = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    ordered = materialized(ordered, "batches")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before)
    out = ordered.join(F.broadcast(offsets.select("_part", "_first", "_before")), "_part")  # a row for each partition
    pos = F.col("_before") + F.col("_id") - F.col("_first")
    return out.withColumn("pos", pos.cast("long")).withColumn("batch", F.floor(F.col("pos") / size)).drop("_part", "_id", "_first", "_before")


def page_of(articles: DataFrame, id_: str, size: int = 8) -> DataFrame:
    """The page, from 1, on which a row stands on its own date; 1 if it isn't there."""
    order = Window.partitionBy("recommend_date").orderBy("batch_order", "id")
    rows = articles.where("recommend_date is not null").withColumn("rn", F.row_number().over(order)).where(F.col("id") == id_)
    return rows.agg(F.coalesce(F.floor((F.max("rn") - 1) / size) + 1, F.lit(1)).cast("long").alias("page"))


def cards(articles: DataFrame, size: int = 8) -> DataFrame:
    """``recommend_date, page, ids, body``: rows as pages of a card, translations where there are any."""
    from feedloom.functions.text import truncated
    from feedloom.operators.aggregates import ordered_text
    from feedloom.operators.select import shown_title

    order = Window.partitionBy("recommend_date").orderBy("batch_order", "id")
    rows = shown_title(articles.where("recommend_date is not null")).withColumn("rn", F.row_number().over(order))
    rows = rows.withColumn("page", (F.floor((F.col("rn") - 1) / size) + 1).cast("int"))
    line = F.concat(F.lit("**"), F.col("title"), F.lit("**\n"), truncated(F.coalesce("abstract", F.lit("")), 200))
    return rows.groupBy("recommend_date", "page").agg(ordered_text("rn", F.col("id"), ",").alias("ids"), ordered_text("rn", line, "\n\n").alias("body"))


def scoring_prompts(articles: DataFrame, preferences: str, size: int = 10) -> DataFrame:
    """``batch, prompt``: the preferences and a block for each row, abstracts cut to 500."""
    from feedloom.functions.text import truncated
    from feedloom.operators.aggregates import ordered_text

    block = F.concat(F.lit("ID: "), "id", F.lit("\nTitle: "), "title", F.lit("\nAbstract: "), truncated(F.coalesce("abstract", F.lit("")), 500))
    rows = in_batches(articles, size, F.desc("created_at"), F.col("id"))
    return rows.groupBy("batch").agg(F.concat(F.lit(preferences + "\n\n"), ordered_text("pos", block, "\n\n")).alias("prompt"))
