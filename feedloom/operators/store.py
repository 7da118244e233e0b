"""Store operations. Each takes a table and gives its next version; only :func:`cleared` changes one in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions.text import nonempty


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def last_of(rows: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """``key`` and ``columns``, one row for each key: the last in ``order``, of equals that of the greatest values."""
    whole = F.struct(*[F.col(c) for c in columns])
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns])
    return rows.groupBy(key).agg(F.max_by(whole, by).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def insert_ignore(table: DataFrame, new: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(next version, inserted rows): rows whose key is in the table are ignored."""
    inserted = first_wins(new.where(F.col(key).isNotNull()), [key], order).join(table.select(key), key, "left_anti")
    inserted = inserted.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
    return table.unionByName(inserted), inserted


def replace_rows(table: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Whole rows are replaced, columns that ``new`` lacks become null; the last in ``order`` wins."""
    last = first_wins(new, [key], [c.desc() if "DESC" not in str(c) else c for c in order])
    last = last.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def upsert_columns(table: DataFrame, new: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Only ``columns`` are overwritten; new keys are inserted; empty keys and values are skipped."""
    good = new.where((F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce(F.col(columns[0]).cast("string"), F.lit("")) != ""))
    last = first_wins(good, [key], [c.desc() for c in order]).select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    out = table.withColumn("_old", F.lit(True)).join(last, key, "full")
    keep = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns]
    return out.select(*keep)


def update_scores(table: DataFrame, scores: DataFrame, order: list[Column]) -> DataFrame:
    """``scores(id, score)``; ids that the table lacks are ignored, the last in ``order`` of several wins (:func:`last_of`)."""
    side = last_of(scores, "id", ["score"], order).withColumnRenamed("score", "_score")
    return table.join(side, "id", "left").withColumn("score", F.coalesce("_score", "score")).drop("_score")


def update_matched(table: DataFrame, new: DataFrame, columns: list[str], order: list[Column], empty_is_null: bool = False) -> DataFrame:
    """Overwrite ``columns`` of matched ids, with nulls too; the last in ``order`` of several wins (:func:`last_of`)."""
    side = last_of(new, "id", columns, order).select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(side, "id", "left")
    for c in columns:
        value = nonempty(F.col(f"_{c}")) if empty_is_null else F.col(f"_{c}")
        out = out.withColumn(c, F.when(F.col("_hit"), value).otherwise(F.col(c)))
    return out.select(*table.columns)


def update_votes(table: DataFrame, votes: DataFrame, at: Column, order: list[Column]) -> DataFrame:
    """Both vote columns of matched ids, a missing vote as null, with the time."""
    stamped = votes.withColumn("votes_updated_at", at)
    return update_matched(table, stamped, ["hf_upvotes", "ax_net_votes", "votes_updated_at"], order)


def mark_pushed(table: DataFrame, ids: list[str], at: Column, most: int = 900) -> DataFrame:
    if len(ids) > most:
        raise ValueError(f"at most {most} ids, not {len(ids)}")
    return table.withColumn("pushed_at", F.when(F.col("id").isin(ids), at).otherwise(F.col("pushed_at")))


def mark_pushed_set(table: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """As :func:`mark_pushed` for a set of any size."""
    side = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return table.join(side, "id", "left").withColumn("pushed_at", F.when(F.col("_hit"), at).otherwise(F.col("pushed_at"))).drop("_hit")


def clear_recommendations(table: DataFrame, date: Column) -> DataFrame:
    gone = F.coalesce(F.col("recommend_date") == date, F.lit(False))
    for c in ("recommendation_type", "batch_order", "recommend_date"):
        table = table.withColumn(c, F.when(~gone, F.col(c)))
    return table


def cleared(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table stored at ``path`` after all its rows are deleted; their files go."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def rated(papers: DataFrame, requests: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(next version, rejected requests) of ``requests(id, title, rating, pin)``, which are done in ``order``.

    A null field asks for nothing. A blank title or a rating outside 1..10 rejects the request. Of the good
    requests for an id the last title and the last rating count, and each pin turns the pin over.
    """
    bad = (F.trim("title") == "") | ~F.col("rating").between(1, 10)
    judged = requests.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    by = [c.alias(f"o{i}") for i, c in enumerate(order)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by, F.col(c)))).alias(f"_{c}")
    side = judged.where("not _bad").groupBy("id").agg(last("title"), last("rating"), (F.count_if("pin") % 2 == 1).alias("_turn"))
    out = papers.join(side, "id", "left")
    out = out.withColumn("title", F.coalesce(F.trim("_title"), "title")).withColumn("rating", F.coalesce("_rating", "rating"))
    out = out.withColumn("pinned", F.col("pinned") != F.coalesce("_turn", F.lit(False)))
    return out.select(*papers.columns), judged.where("_bad").drop("_bad")
