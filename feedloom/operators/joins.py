"""Joins of the feed store. Small sides are left to Spark, which broadcasts by measured size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import nonempty
from feedloom.operators.store import last_of


def not_stored(new: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    return new.join(table.select(key), key, "left_anti")


def in_set(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def in_order(spark: SparkSession, table: DataFrame, ids: list[str]) -> DataFrame:
    """Rows in the order of ``ids``; missing ids are skipped, repeated ones come again."""
    asked = spark.createDataFrame([(ids,)], "ids array<string>").select(F.posexplode("ids").alias("pos", "id"))
    return asked.join(table, "id").orderBy("pos")


def with_abstracts(papers: DataFrame, abstracts: DataFrame, order: list[Column]) -> DataFrame:
    """The last abstract in ``order`` of each paper's arXiv id, empty without one."""
    side = last_of(abstracts.where("abstract is not null"), "arxiv_id", ["abstract"], order).withColumnRenamed("abstract", "_abstract")
    return papers.join(side, "arxiv_id", "left").withColumn("abstract", F.coalesce("_abstract", F.lit(""))).drop("_abstract")


def tool_results(messages: DataFrame) -> DataFrame:
    """``paper, call_id, name, arguments, content``: calls of assistant rows with their results."""
    calls = messages.select("paper", F.explode("tool_calls").alias("c")).select(
        "paper", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments")
    )
    results = messages.where("role = 'tool'").select("paper", F.col("tool_call_id").alias("call_id"), "content")
    return calls.join(results, ["paper", "call_id"], "left")


def first_answer(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str, order: list[Column]) -> DataFrame:
    """``key, value, source`` of the first source that has a value for the key; in it, the last value in ``order``."""
    out = keys.select(key)
    for i, (_, table) in enumerate(sources):
        side = last_of(table.where(F.col(value).isNotNull()), key, [value], order).withColumnRenamed(value, f"_{i}")
        out = out.join(side, key, "left")
    found = [F.when(F.col(f"_{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(sources)]
    return out.select(key, F.coalesce(*[F.col(f"_{i}") for i in range(len(sources))]).alias(value), F.coalesce(*found).alias("source"))


def first_by_file(papers: DataFrame) -> DataFrame:
    """For each arXiv id the paper of the first file name."""
    return papers.where(F.coalesce(nonempty(F.col("arxiv_id")), F.lit("")) != "").groupBy("arxiv_id").agg(F.min_by("ref", "file").alias("ref"))


def resolved_refs(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """``asked, ref, how`` for ``papers(session_id, file, id)``.

    An exact id wins over a unique prefix, then a legacy file name, then a legacy number. A prefix
    that fits several papers is ambiguous. Prefixes of fewer than four characters fit nothing, so
    the prefix join has the first four as its key.
    """
    exact = asked.join(papers, F.col("asked") == F.col("session_id")).select("asked", F.lit(0).alias("rank"), "session_id", F.lit("exact").alias("how"))
    four = asked.where(F.length("asked") >= 4).withColumn("k", F.substring("asked", 1, 4))
    by_prefix = four.join(papers.withColumn("k", F.substring("session_id", 1, 4)), "k").where(F.startswith("session_id", "asked"))
    prefix = by_prefix.groupBy("asked").agg(F.lit(1).alias("rank"), F.min("session_id").alias("session_id"), F.when(F.count(F.lit(1)) == 1, "prefix").otherwise("ambiguous").alias("how"))
    name = asked.join(papers, F.concat("asked", F.lit(".json")) == F.col("file")).select("asked", F.lit(2).alias("rank"), "session_id", F.lit("file").alias("how"))
    number = asked.join(papers, F.col("asked") == F.col("id").cast("string")).select("asked", F.lit(3).alias("rank"), "session_id", F.lit("number").alias("how"))
    every = reduce(DataFrame.unionByName, [exact, prefix, name, number])
    best = every.groupBy("asked").agg(F.min(F.struct("rank", "session_id", "how")).alias("b"))
    ref = F.when(F.col("b.how") != "ambiguous", F.col("b.session_id"))
    return asked.join(best, "asked", "left").select("asked", ref.alias("ref"), F.coalesce("b.how", F.lit("missing")).alias("how"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before ``at``: one union, one window."""
    from pyspark.sql import Window

    extra = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.struct(*extra).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("_side"))
    b = right.select(key, at, F.lit(None).cast(dict(a.dtypes)["_row"]).alias("_row"), value, F.lit(0).alias("_side"))
    frame = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(frame)).where("_side = 1")
    return out.select(key, at, "_row.*", value)


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, begin: str, end: str, width: float) -> DataFrame:
    """Range join: points within ``[begin, end)``, dealt by bins of ``width`` instead of crossed."""
    binned = points.withColumn("_bin", F.floor(F.col(at) / width))
    bins = F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))
    return binned.join(ranges.withColumn("_bin", F.explode(bins)), "_bin").where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin")


def matched(*conditions: Column) -> Column:
    """Whether all conditions hold; null counts as no."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))
