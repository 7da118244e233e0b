"""Chat as an event log: server-sent events, streamed replies, tool dispatch, card patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedloom.functions.fit import split_bytes
from feedloom.operators.aggregates import ordered_text

Tool = Callable[[str], str]
CHUNK = "type string, content string"
#: Processors with state of their own need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def parsed_events(lines: DataFrame) -> DataFrame:
    """``reply, seq, type, content`` of ``lines(reply, seq, line)``: data lines of valid JSON, up to
    the terminator."""
    data = lines.where(F.startswith("line", F.lit("data: "))).withColumn("body", F.trim(F.substring("line", F.lit(7), F.length("line"))))
    end = F.min(F.when(F.col("body") == "[DONE]", F.col("seq"))).over(Window.partitionBy("reply"))
    rows = data.withColumn("_end", end).where("_end is null or seq < _end").withColumn("x", F.from_json("body", CHUNK))
    return rows.where("x.type is not null").select("reply", "seq", "x.type", "x.content")


def replies(events: DataFrame) -> DataFrame:
    """``reply, content``: the text of each reply, in order."""
    return events.where("type = 'text'").groupBy("reply").agg(ordered_text("seq", F.coalesce("content", F.lit("")), "").alias("content"))


def latest_responses(responses: DataFrame) -> DataFrame:
    """Of answers to repeated requests of one view the latest; stale ones are dropped."""
    return responses.groupBy("view").agg(F.max_by("body", "request").alias("body"))


def resolved(tools: dict[str, Tool], name: str | None, arguments: str | None) -> str:
    """What a call of a tool gives; a missing or failing tool is told in words, so the model can go on."""
    if name not in tools:
        return f'Tool "{name or ""}" is not available in this session.'
    try:
        return tools[name](arguments)
    except Exception as error:  # the round goes on
        return f'Tool "{name}" execution failed: {error}'


def dispatched(calls: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """``reply, id, content`` for the first call of each reply; a missing or failing tool is text."""
    first = calls.groupBy("reply").agg(F.min_by(F.struct("id", "name", "arguments"), "index").alias("c")).select("reply", "c.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True)
            out = pa.array([resolved(tools, name, arguments) for name, arguments in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("reply"), batch.column("id"), out], names=["reply", "id", "content"])

    return first.mapInArrow(run, f"reply {dict(calls.dtypes)['reply']}, id string, content string")


def answered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """The log's next rows: each question and its answer in a new round of its paper.

    ``questions(paper, last_round, last_seq, question)``, ``answers(paper, content, prompt,
    completion)``; a question without an answer is kept alone.
    """
    q = questions.select("paper", (F.col("last_seq") + 1).alias("seq"), (F.col("last_round") + 1).alias("round"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("tokens"))
    a = questions.join(answers, "paper").select("paper", (F.col("last_seq") + 2).alias("seq"), (F.col("last_round") + 1).alias("round"), F.lit("assistant").alias("role"), "content", (F.col("prompt") + F.col("completion")).cast("int").alias("tokens"))
    return q.unionByName(a)


def chat_turns(events: DataFrame) -> DataFrame:
    """A stream of ``events(paper, seq, role, content)`` to turns ``paper, round, question, answer``.

    A user row opens a round; the assistant row that follows closes it. An open question is state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, question = state.get if state.exists else (0, None)
        out = []
        for _, e in pd.concat(list(frames)).sort_values("seq").iterrows():
            if e["role"] == "user":
                question = e["content"]
            elif e["role"] == "assistant" and question is not None:
                last, out, question = last + 1, [*out, (key[0], last + 1, question, e["content"])], None
        state.update((last, question))
        yield pd.DataFrame(out, columns=["paper", "round", "question", "answer"])

    schema = f"paper {dict(events.dtypes)['paper']}, round int, question string, answer string"
    return events.groupBy("paper").applyInPandasWithState(step, schema, "round int, question string", "append", GroupStateTimeout.NoTimeout)


class CardPatches(StatefulProcessor):
    """One card's parts. The state goes a while after the last chunk, or after the last word of a card without one."""

    def __init__(self, least: int, most: int, timeout: int | None):
        self.least, self.most, self.timeout = least, most, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", "part int, body string, new int, closed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part, body, new, closed = self.card.get() if self.card.exists() else (0, "", 0, False)
        latest = None
        for c in sorted(rows, key=lambda r: r["seq"]):
            if closed:
                break  # what comes after the last chunk has no card to go to
            body, new, closed = body + c["text"], new + len(c["text"].encode()), c["last"]
            if new >= self.least or closed:
                new = 0
                *full, body = split_bytes(body, self.most)
                for text in full:
                    yield Row(card=key[0], part=part, body=text)
                    part += 1
                yield Row(card=key[0], part=part, body=body)
            if self.timeout:
                latest = max(latest or c["ts"], c["ts"])
        self.card.update((part, body, new, closed))
        if latest:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(latest.timestamp() * 1000) + self.timeout)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        part, body, new, closed = self.card.get()
        self.card.clear()
        if new and not closed:
            *full, body = split_bytes(body, self.most)
            for i, text in enumerate([*full, body]):
                yield Row(card=key[0], part=part + i, body=text)

    def close(self) -> None:
        pass


def patches(chunks: DataFrame, least: int = 200, most: int = 28_000, timeout: int | None = None) -> DataFrame:
    """A stream of ``chunks(card, seq, text, last)`` to ``card, part, body`` patches.

    A patch goes out once ``least`` new bytes have come, or at the last chunk. A body that grows
    over ``most`` bytes is split; its full parts are final and the rest goes on.

    With ``timeout`` in milliseconds chunks need a time ``ts`` under a watermark. Once the watermark is that far past a
    card's latest chunk, what has not gone out goes and the card is forgotten; without it, cards stay. The
    session needs the state store named by ``STORE``.
    """
    schema = f"card {dict(chunks.dtypes)['card']}, part int, body string"
    return chunks.groupBy("card").transformWithState(CardPatches(least, most, timeout), schema, "append", "eventTime" if timeout else "none")
