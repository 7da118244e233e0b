"""What the operators of this package share about the Spark session."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes the shuffle files of an execution at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none, as in tests on one machine, it is a local folder.
    """
    for conf in (spark.conf, spark.sparkContext.getConf()):
        path = conf.get("spark.checkpoint.dir", None)
        if path:
            return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def written(df: DataFrame, name: str, by: str | None = None, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, in folders by column ``by`` if given, and read it back.

    The lineage ends at the table, so a lost executor never makes earlier stages run again, and the
    shuffle files of the write go as soon as it ends. ``buckets``: their number and the column that they go by; the
    table then has a name in the catalog until :func:`deleted_table`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    known = f"feedloom_{path.rsplit('/', 1)[1].replace('-', '_')}"
    try:
        if buckets:
            df.write.bucketBy(*buckets).option("path", path).saveAsTable(known, format="parquet", partitionBy=by)
        else:
            df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    back = spark.table(known) if buckets else spark.read.schema(df.schema).parquet(path)
    back._table_path, back._table_name = path, known if buckets else None
    return back


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def deleted_table(df: DataFrame) -> None:
    """Delete a table that :func:`written` made in buckets."""
    df.sparkSession.sql(f"DROP TABLE {df._table_name}")
    deleted(df.sparkSession, df._table_path)


def bytes_in(spark: SparkSession, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in tables:
        deleted(df.sparkSession, df._table_path)


@cache
def settled() -> None:
    """Called in a Python task: what its process has imported is left out of garbage collection from now on, once for each process.

    Spark's workers collect garbage after every task, which else visits every object of the imported libraries (35 to
    55 ms a task here).
    """
    gc.collect()
    gc.freeze()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
