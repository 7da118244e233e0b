"""The chat engine: questions and streamed replies in, the log of a paper out.

Events ``(paper, at, kind, reply, n, content, skip, call_id, call_type, call_name, arguments, prompt, completion,
cached)`` in the order of ``at``:

- ``question``: opens a round once the round before is closed; the log gets it at once, and a request goes out.
- ``text``: chunk ``n`` of a reply. A reply is named by its request, ``round.pass``.
- ``tool``: a call. The first pass of a round may have one: the tool's result joins the log and a second request
  without tools goes out, whose text goes on after the first pass's. In the second pass it ends the round.
- ``done``: the end, with token counts. ``end``: the end without them.
- ``error``: the round is closed; what text there was is kept as a partial answer.

Chunks of another reply than the open one, and chunks that came before, have no effect, so a source may send
them again. :class:`ChatEngine` keeps one paper's state between micro-batches; :func:`folded_log` says the same of
a whole table of events with joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.operators.aggregates import ordered_text
from feedloom.streaming.chat import STORE, dispatched, resolved  # noqa: F401 - callers set the store

Tool = Callable[[str], str]

EVENT = """paper string, at long, kind string, reply string, n int, content string, skip boolean, call_id string,
    call_type string, call_name string, arguments string, prompt long, completion long, cached long"""
#: A row of the log (``message``), or a request to send (``request``: its ``reply`` names the answer).
LOG = """paper string, kind string, seq int, round int, role string, content string, token_count long,
    prompt_tokens long, completion_tokens long, cached_tokens long, skip_context boolean, call_id string,
    call_type string, call_name string, arguments string, tool_call_id string, reply string, anchor int"""
_COLUMNS = [c.split()[0] for c in LOG.split(",")]
_STATE = "round int, seq int, anchor int, pass int, next int, skip boolean, prompt long"


class ChatEngine(StatefulProcessor):
    """One paper's rounds. ``pass`` is 0 between rounds, else the pass whose reply is awaited.

    Values: the round, the next place in the log, the anchor, the pass, the next chunk. Lists: the texts of the
    open round, and the questions that wait for its end. All lists are empty between rounds.
    """

    def __init__(self, tools: dict[str, Tool], budget: int, least: int, timeout: int | None):
        self.tools, self.budget, self.least, self.timeout = tools, budget, least, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paper = handle.getValueState("paper", _STATE)
        self.texts = handle.getListState("texts", "content string")
        self.waiting = handle.getListState("waiting", "question string, skip boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.paper.update((initialState["round"], initialState["seq"], initialState["anchor"], 0, 0, False, 0))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for e in sorted(rows, key=lambda r: r["at"]):
            if e["kind"] == "question":
                yield from self._asked(key[0], e["content"], bool(e["skip"]))
            else:
                yield from self._replied(key[0], e)
            if self.timeout and e["ts"] is not None:
                self._wait(e["ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._get()
        if state["pass"]:
            yield from self._closed(key[0], state, partial=True)
        if self._get()["pass"]:  # a question that waited
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.timeout)

    def close(self) -> None:
        pass

    def _get(self) -> dict:
        names = [c.split()[0] for c in _STATE.split(",")]
        found = self.paper.get() if self.paper.exists() else (0, 0, 0, 0, 0, False, 0)
        return dict(zip(names, found, strict=True))

    def _put(self, state: dict) -> None:
        self.paper.update(tuple(state.values()))

    def _wait(self, ts: datetime) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self._get()["pass"]:
            self.handle.registerTimer(int(ts.timestamp() * 1000) + self.timeout)

    def _message(self, paper, state: dict, role: str, content: str, **more) -> Row:
        row = dict.fromkeys(_COLUMNS) | {"paper": paper, "kind": "message", "seq": state["seq"], "round": state["round"], "role": role, "content": content}
        row |= {"token_count": len(content.encode()) // 4, "prompt_tokens": 0, "completion_tokens": 0, "cached_tokens": 0, "skip_context": state["skip"], "anchor": state["anchor"]} | more
        state["seq"] += 1
        return Row(**row)

    def _request(self, paper, state: dict) -> Row:
        reply = f"{state['round']}.{state['pass']}"
        return Row(**dict.fromkeys(_COLUMNS) | {"paper": paper, "kind": "request", "round": state["round"], "reply": reply, "anchor": state["anchor"]})

    def _asked(self, paper, question: str | None, skip: bool) -> Iterator[Row]:
        if not question:
            return
        state = self._get()
        if state["pass"]:
            self.waiting.appendValue((question, skip))
            return
        state |= {"round": state["round"] + 1, "pass": 1, "next": 0, "skip": skip}
        yield self._message(paper, state, "user", question)
        yield self._request(paper, state)
        self._put(state)

    def _replied(self, paper, e: Row) -> Iterator[Row]:
        state = self._get()
        if not state["pass"] or e["reply"] != f"{state['round']}.{state['pass']}" or e["n"] < state["next"]:
            return
        state["next"] = e["n"] + 1
        if e["kind"] == "text":
            if e["content"]:
                self.texts.appendValue((e["content"],))
            self._put(state)
        elif e["kind"] == "tool" and state["pass"] == 1:
            call = {c: e[c] for c in ("call_id", "call_type", "call_name", "arguments")}
            yield self._message(paper, state, "assistant", "", **call)
            yield self._message(paper, state, "tool", resolved(self.tools, e["call_name"], e["arguments"]), tool_call_id=e["call_id"])
            state |= {"pass": 2, "next": 0}
            yield self._request(paper, state)
            self._put(state)
        elif e["kind"] == "done":
            yield from self._closed(paper, state, e["prompt"] or 0, e["completion"] or 0, e["cached"] or 0)
        else:
            yield from self._closed(paper, state, partial=e["kind"] == "error")

    def _closed(self, paper, state: dict, prompt: int = 0, completion: int = 0, cached: int = 0, partial: bool = False) -> Iterator[Row]:
        answer = "".join(t[0] for t in self.texts.get())
        if answer or not partial:
            if prompt + completion > self.budget:
                state["anchor"] = max(1, state["round"] - self.least + 1)
            yield self._message(paper, state, "assistant", answer, prompt_tokens=prompt, completion_tokens=completion, cached_tokens=cached)
        state["pass"] = 0
        self.texts.clear()
        self._put(state)
        waiting = list(self.waiting.get())
        if waiting:
            (question, skip), *rest = waiting
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield from self._asked(paper, question, skip)


def chat_log(
    events: DataFrame, tools: dict[str, Tool], budget: int = 30_000, least: int = 2, timeout: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """The rows that a stream (or table) of events adds to the logs, and the requests to send: type ``LOG``.

    ``initial(paper, round, seq, anchor)``: where the logs stand (the last round, the next place). With
    ``timeout`` in milliseconds events need a time ``ts`` under a watermark: a round whose last event is older
    than that is closed like one that failed. The session needs the state store named by ``STORE``.
    """
    engine = ChatEngine(tools, budget, least, timeout)
    first = initial.groupBy("paper") if initial is not None else None
    log = LOG.replace("paper string", f"paper {dict(events.dtypes)['paper']}", 1)
    return events.groupBy("paper").transformWithState(engine, log, "append", "eventTime" if timeout else "none", first)


def folded_log(events: DataFrame, tools: dict[str, Tool], budget: int = 30_000, least: int = 2) -> DataFrame:
    """The messages of :func:`chat_log` for whole logs of events, from round 1 on; type ``LOG``.

    Each chunk must come after its request, as a source that answers requests has it.
    """
    order = Window.partitionBy("paper").orderBy("at")
    asked = events.where("kind = 'question' and content <> ''").select("paper", F.row_number().over(order).alias("round"), F.col("content").alias("question"), F.coalesce("skip", F.lit(False)).alias("skip"))
    ends = F.min(F.when(F.col("kind") != "text", F.col("n"))).over(Window.partitionBy("paper", "reply"))
    once = events.where("kind <> 'question'").groupBy("paper", "reply", "n").agg(F.min_by(F.struct(*[c for c in events.columns if c not in ("paper", "reply", "n")]), "at").alias("e"))
    chunks = once.select("paper", "reply", "n", "e.*").withColumn("_end", ends).where("_end is null or n <= _end")
    at_end = lambda c: F.max(F.when(F.col("kind") != "text", F.col(c))).alias(c)
    text = ordered_text("n", F.when(F.col("kind") == "text", F.coalesce("content", F.lit(""))).otherwise(""), "").alias("text")
    ended = [at_end(c) for c in ("kind", "call_id", "call_type", "call_name", "arguments", "prompt", "completion", "cached")]
    part = lambda i: F.split_part("reply", F.lit("."), F.lit(i)).cast("int")
    replies = chunks.groupBy("paper", part(1).alias("round"), part(2).alias("pass")).agg(text, *ended)
    first, second = replies.where("pass = 1").drop("pass"), replies.where("pass = 2")
    rounds = asked.join(first, ["paper", "round"], "left")
    calls = rounds.where("kind = 'tool'").select(F.struct("paper", "round").alias("reply"), F.lit(0).alias("index"), F.col("call_id").alias("id"), F.col("call_name").alias("name"), "arguments")
    results = dispatched(calls, tools).select("reply.paper", "reply.round", F.col("content").alias("result"))
    second = second.select("paper", "round", *[F.col(c).alias(f"{c}2") for c in ("text", "kind", "prompt", "completion", "cached")])
    rounds = rounds.join(results, ["paper", "round"], "left").join(second, ["paper", "round"], "left")

    called = F.col("kind") == "tool"
    answer = F.concat(F.coalesce("text", F.lit("")), F.when(called, F.coalesce("text2", F.lit(""))).otherwise(""))
    ending = F.when(called, F.col("kind2")).otherwise(F.col("kind"))
    counts = [F.when(ending == "done", F.coalesce(F.when(called, F.col(f"{c}2")).otherwise(F.col(c)), F.lit(0))).otherwise(0).cast("long").alias(f"{c}_tokens") for c in ("prompt", "completion")]
    cached = F.when(ending == "done", F.coalesce(F.when(called, F.col("cached2")).otherwise(F.col("cached")), F.lit(0))).otherwise(0).cast("long").alias("cached_tokens")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    no_call = [none.alias(c) for c in ("call_id", "call_type", "call_name", "arguments")]
    no_counts = [zero.alias(f"{c}_tokens") for c in ("prompt", "completion", "cached")]

    def message(rows: DataFrame, place: int, role: str, content, numbers: list, call: list, tool_call_id) -> DataFrame:
        return rows.select("paper", "round", F.lit(place).alias("place"), F.lit(role).alias("role"), content.alias("content"), *numbers, F.col("skip").alias("skip_context"), *call, tool_call_id.alias("tool_call_id"))

    log = message(rounds, 0, "user", F.col("question"), no_counts, no_call, none)
    with_call = rounds.where(called)
    log = log.unionByName(message(with_call, 1, "assistant", F.lit(""), no_counts, [F.col(c) for c in ("call_id", "call_type", "call_name", "arguments")], none))
    log = log.unionByName(message(with_call, 2, "tool", F.col("result"), no_counts, no_call, F.col("call_id")))
    answered = rounds.where(ending.isNotNull() & ((ending != "error") | (answer != "")))
    log = log.unionByName(message(answered, 3, "assistant", answer, [*counts, cached], no_call, none))

    so_far = Window.partitionBy("paper").orderBy("round", "place")
    moved = F.when(F.col("prompt_tokens") + F.col("completion_tokens") > budget, F.greatest(F.lit(1), F.col("round") - least + 1))
    anchor = F.coalesce(F.last(moved, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    log = log.withColumns({"seq": F.row_number().over(so_far) - 1, "anchor": anchor, "kind": F.lit("message"), "reply": none})
    return log.withColumn("token_count", F.floor(F.octet_length("content") / 4)).select(*_COLUMNS)
