"""Send this package to executors that can't import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT = "_feedloom_sent"
#: Bytes of rows in a batch that a Python task gets, about. Spark's own limit is 64 MB, of which an executor holds
#: several at once: as Arrow vectors of the JVM, and in each worker with what is made of them.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the session's executors, once for each context.

    Batches of rows for Python are limited to ``BATCH_BYTES`` from then on, unless the application's configuration has a limit.
    """
    context = spark.sparkContext
    if getattr(context, _SENT, False):
        return
    if not context.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "feedloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    out.write(at, os.path.join("feedloom", os.path.relpath(at, root)))
    context.addPyFile(path)
    setattr(context, _SENT, True)
