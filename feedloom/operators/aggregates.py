"""Aggregations over articles, papers and message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the statuses in statistics.
STATUSES = {"unread": 0, "read": 3, "activated": 1, "liked": 2, "disliked": -1}
# Names of main files, the first that exists is taken.
MAIN_NAMES = ("main.tex", "paper.tex", "index.tex")


def status_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def statistics(articles: DataFrame) -> DataFrame:
    """One row: a count for each status, and the total."""
    return articles.agg(*[F.count_if(F.col("status") == v).alias(n) for n, v in STATUSES.items()], F.count(F.lit(1)).alias("total"))


def unpushed(articles: DataFrame) -> DataFrame:
    return articles.where("pushed_at is null and recommend_date is not null").agg(F.count(F.lit(1)).alias("n"))


def last_push(articles: DataFrame) -> DataFrame:
    """The latest push as text, empty if there was none."""
    return articles.agg(F.coalesce(F.date_format(F.max("pushed_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("last_push"))


def recommendation_dates(articles: DataFrame) -> DataFrame:
    return articles.where("recommend_date is not null").select("recommend_date").distinct().orderBy(F.desc("recommend_date"))


def token_totals(messages: DataFrame) -> DataFrame:
    sums = ["token_count", "prompt_tokens", "completion_tokens", "cached_tokens"]
    return messages.groupBy("paper").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def round_range(messages: DataFrame) -> DataFrame:
    return messages.groupBy("paper").agg(F.coalesce(F.min("round"), F.lit(0)).alias("first"), F.coalesce(F.max("round"), F.lit(0)).alias("last"))


def next_id(papers: DataFrame) -> DataFrame:
    return papers.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def ordered_text(seq: str, text: Column, separator: str) -> Column:
    """An aggregate: the texts of a group in the order of ``seq``, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def formatted_rounds(messages: DataFrame) -> DataFrame:
    """``paper, text``: the log as questions and answers; tool rows are left out."""
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.coalesce("content", F.lit("")))
    return messages.where("role <> 'tool'").groupBy("paper").agg(ordered_text("seq", line, "\n\n").alias("text"))


def assembled_calls(deltas: DataFrame) -> DataFrame:
    """``reply, index, id, type, name, arguments`` of streamed tool-call deltas, in order of ``seq``.

    Id, type and name are the last that aren't empty; arguments are joined. Indices may have gaps.
    """
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    joined = ordered_text("seq", F.coalesce("arguments", F.lit("")), "")
    return deltas.groupBy("reply", "index").agg(*[F.coalesce(last(c), F.lit("")).alias(c) for c in ("id", "type", "name")], joined.alias("arguments"))


def main_file(files: DataFrame) -> DataFrame:
    """Of each archive its main file: a common name first, else the longest, the first of equals; none without one."""
    from feedloom.functions.text import looks_like_main_tex

    common = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, reversed(MAIN_NAMES))), F.col("path")), F.lit(0)), F.lit(0))
    rank = F.struct(common.alias("m"), F.length("content").alias("n"), (-F.col("walk")).alias("w"))
    return files.where(looks_like_main_tex(F.col("content"))).groupBy("archive").agg(F.max_by("path", rank).alias("path"))


def running_totals(messages: DataFrame, column: str) -> DataFrame:
    order = Window.partitionBy("paper").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn(f"total_{column}", F.sum(column).over(order))
