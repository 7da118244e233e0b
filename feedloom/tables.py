"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def materialized(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` (in folders by ``by``, if given) and read back, so that all
    readers see the same rows.

    Without that setting a local session uses a temporary folder; a cluster session must set it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
