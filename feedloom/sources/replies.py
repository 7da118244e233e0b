"""Streamed replies of language models: lines of a relay as a stream source, and what the lines say.

Workers that hold the connections to a model append each line they get to a relay's log. The log has one
running number, so an offset of the stream is one number however many replies are open, and a range of lines
is read in parts by several tasks.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from feedloom.operators.aggregates import assembled_calls, ordered_text

#: Asks the relay: a path and a query to the text of the reply.
Ask = Callable[[str], str]
#: The form of a line's JSON.
CHUNK = """choices array<struct<delta: struct<content: string, tool_calls: array<struct<
    `index`: int, id: string, type: string, function: struct<name: string, arguments: string>>>>>>,
    usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint, prompt_tokens_details: struct<cached_tokens: bigint>>"""
PREFIX, DONE = "data: ", "[DONE]"


@dataclass
class Lines(InputPartition):
    begin: int
    end: int


class RelayReader(DataSourceStreamReader):
    """Lines ``begin`` to ``end`` of the log; what is committed the relay may forget."""

    def __init__(self, options: dict[str, str], ask: Ask | None):
        self.url = options.get("url", "").rstrip("/")
        self.part = int(options.get("lines_per_task", 10_000))
        self.ask, self.begin = ask, int(options.get("begin", 0))

    def _asked(self, path: str) -> str:
        if self.ask:
            return self.ask(path)
        with urllib.request.urlopen(f"{self.url}/{path}", timeout=30) as reply:
            return reply.read().decode()

    def initialOffset(self) -> dict:
        return {"line": self.begin}

    def latestOffset(self) -> dict:
        return {"line": int(self._asked("end"))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Lines(a, min(a + self.part, end["line"])) for a in range(start["line"], end["line"], self.part)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        for row in json.loads(self._asked(f"lines?from={partition.begin}&to={partition.end}")):
            yield row["at"], row["reply"], row["line"]

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, ask: Ask | None = None, name: str = "relay") -> None:
    """Make the stream format ``name`` known: rows ``seq, reply, line``; ``seq`` is the place in the relay's log.

    Options: ``url`` of the relay; ``begin``, the first line; ``lines_per_task``. A batch is what the log has more.
    """

    class Relay(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "seq long, reply string, line string"

        def streamReader(self, schema: StructType) -> RelayReader:
            return RelayReader(dict(self.options), ask)

    spark.dataSource.register(Relay)


def parsed_chunks(lines: DataFrame) -> DataFrame:
    """``reply, seq, done, content, calls, usage`` of ``lines(reply, seq, line)``; works on streams.

    Lines without the prefix and lines that are no JSON go. ``done`` marks the terminator. A line with calls has
    no content; empty content is null.
    """
    rows = lines.where(F.startswith("line", F.lit(PREFIX))).withColumn("body", F.substring("line", F.lit(len(PREFIX) + 1), F.length("line")))
    rows = rows.withColumn("done", F.col("body") == DONE).withColumn("x", F.from_json("body", CHUNK))
    delta = F.get("x.choices", F.lit(0))["delta"]
    calls = F.when(F.size(delta["tool_calls"]) > 0, delta["tool_calls"])
    rows = rows.select("reply", "seq", "done", F.when(calls.isNull(), F.nullif(delta["content"], F.lit(""))).alias("content"), calls.alias("calls"), F.col("x.usage").alias("usage"))
    return rows.where("done or content is not null or calls is not null or usage is not null")


def _before_done(chunks: DataFrame) -> DataFrame:
    end = chunks.where("done").groupBy("reply").agg(F.min("seq").alias("_end"))
    return chunks.join(end, "reply", "left").where("_end is null or seq < _end")


def completed(chunks: DataFrame) -> DataFrame:
    """``reply, content, done, prompt, completion, total, cached`` of whole replies; the last usage counts, none is 0.

    ``done`` tells whether the terminator came. What follows it goes.
    """
    ended = chunks.groupBy("reply").agg(F.max("done").alias("done"))
    rows = _before_done(chunks).groupBy("reply").agg(ordered_text("seq", F.coalesce("content", F.lit("")), "").alias("content"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("u"))
    count = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0))
    counts = {"prompt": count("prompt_tokens"), "completion": count("completion_tokens"), "total": count("total_tokens"), "cached": count("prompt_tokens_details.cached_tokens")}
    return ended.join(rows, "reply", "left").select("reply", F.coalesce("content", F.lit("")).alias("content"), "done", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()])


def completed_calls(chunks: DataFrame) -> DataFrame:
    """``reply, index, id, type, name, arguments`` of the calls in whole replies that came to their terminator."""
    done = chunks.where("done").select("reply").distinct()
    deltas = _before_done(chunks).join(done, "reply", "left_semi").select("reply", "seq", F.posexplode("calls").alias("k", "c"))
    return assembled_calls(deltas.select("reply", F.col("c.index").alias("index"), F.struct("seq", "k").alias("seq"), "c.id", "c.type", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments")))


def as_events(chunks: DataFrame) -> DataFrame:
    """Events of :mod:`feedloom.streaming.engine` for replies named ``paper/round.pass``, of whole replies.

    A reply with calls ends in its first call, as ``tool``; one with the terminator in ``done`` with its tokens;
    any other in ``end``.
    """
    paper, reply = F.split_part("reply", F.lit("/"), F.lit(1)).alias("paper"), F.split_part("reply", F.lit("/"), F.lit(2)).alias("reply")
    text = _before_done(chunks).where("content is not null").select("reply", F.col("seq").alias("at"), F.lit("text").alias("kind"), "content")
    first = completed_calls(chunks).groupBy("reply").agg(F.min_by(F.struct("id", "type", "name", "arguments"), "index").alias("c"))
    last = chunks.groupBy("reply").agg(F.max("seq").alias("at"))
    ends = completed(chunks).join(first, "reply", "left").join(last, "reply")
    kind = F.when(F.col("c").isNotNull(), "tool").when(F.col("done"), "done").otherwise("end")
    ends = ends.select("reply", (F.col("at") + 1).alias("at"), kind.alias("kind"), F.lit(None).cast("string").alias("content"), F.col("c.id").alias("call_id"), F.col("c.type").alias("call_type"), F.col("c.name").alias("call_name"), "c.arguments", "prompt", "completion", "cached")
    rows = text.unionByName(ends, allowMissingColumns=True).withColumn("n", F.expr("row_number() over (partition by reply order by at) - 1"))
    return rows.select(paper, "at", "kind", reply, "n", "content", F.lit(False).alias("skip"), "call_id", "call_type", "call_name", "arguments", "prompt", "completion", "cached")
