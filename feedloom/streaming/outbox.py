"""A sink with commits, for tables and streams: ``df.write.format("outbox")`` and ``df.writeStream.format("outbox")``.

Each task writes its rows to a file of its own below ``staged/``; a commit names the files that count, in one
file below ``commits/`` that appears at once. What a failed task or job has written is named nowhere, so
nobody reads it. A commit that is there already stays as it is: a batch that is run again, by its number in a
stream or by the option ``commit``, adds nothing.

A ``send`` function takes the rows on their way, in the order in which the task has them. The first failure
fails the task, and so the batch. As a task can be run again, ``send`` gets a key to tell what it has seen.
Rows pass from executors to files or receivers; the driver sees the names of the files alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Takes a key and one row (as a dict); raises if it can't be delivered.
Send = Callable[[str, dict], None]


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class _Writer:
    def __init__(self, options: dict[str, str], send: Send | None):
        self.path, self.raw, self.send = options["path"], options.get("raw"), send
        at, root = files_at(self.path)
        for folder in ("staged", "commits"):
            at.create_dir(f"{root}/{folder}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Staged:
        at, root = files_at(self.path)
        name, n = f"{uuid.uuid4().hex}.json", 0
        with at.open_output_stream(f"{root}/staged/{name}") as out:
            for row in iterator:
                own = row.asDict(recursive=True)
                if self.send:
                    self.send(f"{self.key}-{own.get('key', n)}", own)
                out.write((str(own[self.raw]) if self.raw else json.dumps(own, default=str, ensure_ascii=False) + "\n").encode())
                n += 1
        return Staged(name, n)

    def committed(self, messages: list[Staged | None], commit: str) -> None:
        at, root = files_at(self.path)
        final = f"{root}/commits/{commit}.json"
        if at.get_file_info(final).type == fs.FileType.File:
            self.aborted(messages)
            return
        found = [m for m in messages if m and m.rows]
        hidden = f"{root}/commits/.{commit}-{uuid.uuid4().hex}"  # Spark passes over such names
        with at.open_output_stream(hidden) as out:
            out.write(json.dumps({"commit": commit, "rows": sum(m.rows for m in found), "files": [m.file for m in found]}).encode())
        at.move(hidden, final)

    def aborted(self, messages: list[Staged | None]) -> None:
        at, root = files_at(self.path)
        for m in messages:
            if m:
                at.delete_file(f"{root}/staged/{m.file}")


class OutboxWriter(_Writer, DataSourceWriter):
    def __init__(self, options: dict[str, str], send: Send | None):
        super().__init__(options, send)
        self.key = options.get("commit") or uuid.uuid4().hex

    def commit(self, messages: list[Staged | None]) -> None:
        self.committed(messages, self.key)

    def abort(self, messages: list[Staged | None]) -> None:
        self.aborted(messages)


class OutboxStreamWriter(_Writer, DataSourceStreamWriter):
    def __init__(self, options: dict[str, str], send: Send | None):
        super().__init__(options, send)
        self.key = options.get("commit", "batch")

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.committed(messages, f"{self.key}-{batchId:09d}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.aborted(messages)


def files_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def register(spark: SparkSession, send: Send | None = None, name: str = "outbox") -> None:
    """Make the format ``name`` known, with ``send`` for its rows.

    Options: ``path``, a folder that driver and executors share; ``commit``, the batch's key (of a stream: its
    prefix); ``raw``, a column whose text is written as it is, instead of each row as a line of JSON.
    """

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> OutboxWriter:
            return OutboxWriter(dict(self.options), send)

        def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxStreamWriter:
            return OutboxStreamWriter(dict(self.options), send)

    spark.dataSource.register(Outbox)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``commit, rows, file`` of all that is committed."""
    _Writer({"path": path}, None)
    rows = spark.read.schema("commit string, rows long, files array<string>").json(f"{path}/commits")
    return rows.select("commit", "rows", F.explode("files").alias("file"))


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits, of type ``schema``, with their ``commit``."""
    files = commits(spark, path).select("commit", "file")
    rows = spark.read.schema(schema).json(f"{path}/staged").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(files, "file").drop("file")
