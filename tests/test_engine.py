import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.plans import flows
from feedloom.streaming import engine

AT = "/root/testdata/sf0.001"


def bad(_):
    raise ValueError("no")


TOOLS = {"up": str.upper, "bad": bad}


@pytest.fixture
def store(spark):
    spark.conf.set(*engine.STORE)
    yield
    spark.conf.unset(engine.STORE[0])


def event(at, kind, content=None, reply=None, n=None, paper="p", **more):
    return {"paper": paper, "at": at, "kind": kind, "content": content, "reply": reply, "n": n, **more}


def stream(spark, at, frames, first=0, schema=engine.EVENT):
    """A file stream of one micro-batch for each frame; may be called again with more frames."""
    at.mkdir(exist_ok=True)
    for i, rows in enumerate(frames, first):
        (at / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(at / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(at))


def run(log, tmp_path):
    """Rows of all runs so far, from a folder that each micro-batch is written to once."""
    out = tmp_path / "out"
    log.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return log.sparkSession.read.parquet(str(out)).collect()


def said(rows):
    return [(r.seq, r.round, r.role, r.content) for r in sorted((r for r in rows if r.kind == "message"), key=lambda r: (r.paper, r.seq))]


def test_stream_equals_fold_over_a_restart(spark, store, tmp_path):
    events = [r.asDict() for r in flows.chat_events(spark, AT).collect()]
    by = defaultdict(list)
    for e in sorted(events, key=lambda e: e["at"]):
        by[e["at"] // 150_000].append(e)  # some rounds lie in several micro-batches
    frames = [by[k] for k in sorted(by)]
    assert len(frames) > 4
    schema = engine.EVENT.replace("paper string", "paper long")
    half = len(frames) // 2
    log = engine.chat_log(stream(spark, tmp_path / "in", frames[:half], schema=schema), flows.CHAT_TOOLS, budget=700)
    run(log, tmp_path)
    again = engine.chat_log(stream(spark, tmp_path / "in", frames[half:], half, schema), flows.CHAT_TOOLS, budget=700)
    rows = run(again, tmp_path)
    fields = lambda r: tuple(r[c] for c in engine._COLUMNS)
    got = sorted((fields(r) for r in rows if r.kind == "message"), key=str)
    want = sorted((fields(r) for r in engine.folded_log(spark.createDataFrame(events, schema), flows.CHAT_TOOLS, budget=700).collect()), key=str)
    assert got == want
    assert {r.role for r in rows if r.kind == "message"} == {"user", "assistant", "tool"}
    assert any(r.anchor > 1 for r in rows)


def test_question_tool_answer_anchor(spark, store, tmp_path):
    frames = [
        [event(1, "question", "why?", skip=True), event(2, "text", "Let ", "1.1", 0)],
        [event(3, "text", "me see: ", "1.1", 1), event(4, "tool", reply="1.1", n=2, call_id="c1", call_type="function", call_name="up", arguments="x")],
        [event(5, "text", "late", "1.1", 3), event(6, "text", "so", "1.2", 0), event(6, "text", "so", "1.2", 0), event(7, "done", reply="1.2", n=1, prompt=900, completion=200, cached=7)],
    ]
    rows = run(engine.chat_log(stream(spark, tmp_path / "in", frames), TOOLS, budget=1000), tmp_path)
    assert said(rows) == [(0, 1, "user", "why?"), (1, 1, "assistant", ""), (2, 1, "tool", "X"), (3, 1, "assistant", "Let me see: so")]
    last = next(r for r in rows if r.seq == 3)
    assert (last.prompt_tokens, last.completion_tokens, last.cached_tokens, last.anchor, last.skip_context) == (900, 200, 7, 1, True)
    assert next(r.tool_call_id for r in rows if r.role == "tool") == "c1"
    assert sorted(r.reply for r in rows if r.kind == "request") == ["1.1", "1.2"]


def test_errors_keep_partial_answers_and_questions_wait(spark, store, tmp_path):
    frames = [
        [event(1, "question", "a"), event(2, "question", ""), event(3, "question", "b"), event(4, "text", "par", "1.1", 0)],
        [event(5, "error", "reset", "1.1", 1), event(6, "error", "down", "2.1", 0), event(7, "question", "c"), event(8, "tool", reply="3.1", n=0, call_name="none", arguments="")],
        [event(9, "end", reply="3.2", n=0), event(10, "question", "d"), event(11, "tool", reply="4.1", n=0, call_name="bad", arguments=""), event(12, "tool", reply="4.2", n=0, call_name="up", arguments="")],
    ]
    rows = run(engine.chat_log(stream(spark, tmp_path / "in", frames), TOOLS), tmp_path)
    missing, failed = 'Tool "none" is not available in this session.', 'Tool "bad" execution failed: no'
    want = [(1, "user", "a"), (1, "assistant", "par"), (2, "user", "b"), (3, "user", "c"), (3, "assistant", ""), (3, "tool", missing), (3, "assistant", "")]
    want += [(4, "user", "d"), (4, "assistant", ""), (4, "tool", failed), (4, "assistant", "")]
    assert [x[1:] for x in said(rows)] == want
    folded = engine.folded_log(spark.createDataFrame([e for f in frames for e in f], engine.EVENT), TOOLS).collect()
    assert said(folded) == said(rows)


def test_logs_go_on_where_they_stand(spark, store, tmp_path):
    standing = spark.createDataFrame([("p", 4, 9, 3)], "paper string, round int, seq int, anchor int")
    frames = [[event(1, "question", "a"), event(2, "text", "b", "5.1", 0), event(3, "end", reply="5.1", n=1), event(4, "question", "q", paper="z")]]
    rows = run(engine.chat_log(stream(spark, tmp_path / "in", frames), TOOLS, initial=standing), tmp_path)
    assert sorted((r.paper, r.seq, r.round, r.anchor) for r in rows if r.kind == "message") == [("p", 9, 5, 3), ("p", 10, 5, 3), ("z", 0, 1, 0)]


def test_a_round_without_a_word_is_closed_by_the_watermark(spark, store, tmp_path):
    ts = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    frames = [
        [event(1, "question", "a", ts=ts(0)), event(2, "text", "par", "1.1", 0, ts=ts(1)), event(3, "question", "b", ts=ts(2))],
        [event(1, "question", "z", paper="other", ts=ts(20))],
        [event(2, "end", reply="1.1", n=0, paper="other", ts=ts(21))],
    ]
    source = stream(spark, tmp_path / "in", frames, schema=engine.EVENT + ", ts timestamp").withWatermark("ts", "1 minute")
    rows = run(engine.chat_log(source, TOOLS, timeout=5 * 60_000), tmp_path)
    assert [(r.seq, r.role, r.content) for r in sorted((r for r in rows if r.kind == "message" and r.paper == "p"), key=lambda r: r.seq)] == [(0, "user", "a"), (1, "assistant", "par"), (2, "user", "b")]


def test_fold_of_an_empty_table(spark):
    assert engine.folded_log(spark.createDataFrame([], engine.EVENT), TOOLS).collect() == []
    assert engine.folded_log(spark.createDataFrame([event(1, "question", "a")], engine.EVENT), TOOLS).where(F.col("seq") == 0).count() == 1
