"""Logs kept as a table partitioned by local day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def write_daily(lines: DataFrame, path: str, zone: str = "UTC") -> None:
    """Append ``lines(ts, line)`` by day."""
    lines.withColumn("day", local_day(F.col("ts"), zone)).write.mode("append").partitionBy("day").parquet(path)


def kept_lines(table: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """The lines of a table by ``day`` whose day isn't before the cutoff: a filter of partitions, other days are not read."""
    return table.where(F.col("day") >= F.date_sub(as_of, keep))


def without_old_days(spark: SparkSession, path: str, as_of: str, keep: int) -> list[str]:
    """Drop the days before the cutoff from the table that :func:`write_daily` has written at ``path``; gives the days.

    Whole folders go, no line is read or written again. Lines without a day stay.
    """
    days = spark.createDataFrame([(x.split("=", 1)[1],) for x in _day_folders(spark, path)], "day string")
    old = [r.day for r in days.where(F.try_to_date("day", "yyyy-MM-dd") < F.date_sub(F.lit(as_of).cast("date"), keep)).orderBy("day").collect()]  # a row a day
    fs, at = _files(spark, path)
    for day in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"day={day}"), True)
    return old


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _day_folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("day="))


def kept_days(names: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """File names that stay: those without a date, and those whose date isn't before the cutoff."""
    day = F.try_to_date(F.nullif(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    return names.where(day.isNull() | (day >= F.date_sub(as_of, keep)))


def recent(lines: DataFrame, n: int, ring: int = 500) -> DataFrame:
    """The latest ``n`` lines (at most ``ring``), oldest first."""
    return lines.orderBy(F.desc("ts"), F.desc("id")).limit(min(n, ring)).orderBy("ts", "id")
