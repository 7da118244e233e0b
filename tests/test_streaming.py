import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.streaming import chat, jobs, status, windows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path, frames, schema):
    """A file stream of one micro-batch for each frame."""
    at = tmp_path / "in"
    at.mkdir()
    for i, rows in enumerate(frames):
        (at / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(at / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(at))


def drained(df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_fold_equals_the_batch(spark, tmp_path):
    rows = [r.asDict() for r in spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type").orderBy("ts", "event_id").collect()]
    frames = [rows[i : i + 400] for i in range(0, len(rows), 400)]
    source = stream(spark, tmp_path, frames, "event_id long, ts string, user_id long, event_type string").withColumn("v", status.event_status(F.col("event_type")))
    out = drained(status.folded_stream(source, "user_id", ["ts", "event_id"]), "fold", "update", tmp_path)
    last = {}
    for r in out.collect():
        last[r.user_id] = r.status
    batch = spark.createDataFrame(rows).withColumn("v", status.event_status(F.col("event_type")))
    assert last == {r.user_id: r.status for r in status.folded(batch, "user_id", ["ts", "event_id"]).collect()}


def test_tumbling_stream_equals_closed_batch_windows(spark, tmp_path):
    rows = [r.asDict() for r in spark.read.parquet(EVENTS).select(F.col("ts").cast("string").alias("ts"), "event_type", "value").orderBy("ts").collect()]
    source = stream(spark, tmp_path, [rows[:500], rows[500:]], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.start, r.event_type, r.n) for r in drained(windows.tumbling(source, "1 hour", ["event_type"], "1 hour"), "tumbling", "append", tmp_path).collect()}
    batch = {(r.start, r.event_type, r.n) for r in windows.tumbling(spark.read.parquet(EVENTS), "1 hour", ["event_type"]).collect()}
    assert got <= batch
    assert len(got) > 0.9 * len(batch)


def test_deduplication(spark, tmp_path):
    rows = [{"ts": f"2024-01-01 00:00:0{i}", "k": i % 3} for i in range(9)]
    source = stream(spark, tmp_path, [rows[:5], rows[5:]], "ts string, k int").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.k for r in drained(windows.deduplicated(source, ["k"], "1 hour"), "dedup", "append", tmp_path).collect()) == [0, 1, 2]


def test_chat_turns_over_batches(spark, tmp_path):
    rows = [{"paper": "p", "seq": i, "role": r, "content": f"{r}{i}"} for i, r in enumerate(["user", "assistant", "user", "tool", "assistant", "assistant", "user"])]
    source = stream(spark, tmp_path, [rows[:3], rows[3:]], "paper string, seq int, role string, content string")
    got = [tuple(r) for r in drained(chat.chat_turns(source), "turns", "append", tmp_path).collect()]
    assert got == [("p", 1, "user0", "assistant1"), ("p", 2, "user2", "assistant4")]


def test_patches_flush_by_size_and_split(spark, tmp_path):
    spark.conf.set(*chat.STORE)
    rows = [{"card": "c", "seq": i, "text": "x" * 90 + "\n", "last": i == 9} for i in range(10)]
    source = stream(spark, tmp_path, [rows[:4], rows[4:]], "card string, seq int, text string, last boolean")
    got = drained(chat.patches(source, least=200, most=500), "patches", "append", tmp_path).collect()
    final = {}
    for r in got:
        final[r.part] = r.body
    assert "".join(final[p] for p in sorted(final)) == "".join(r["text"] for r in rows)
    assert all(len(b) <= 500 for b in final.values())
    assert len(got) < 10
    spark.conf.unset(chat.STORE[0])


def test_events_replies_and_tools(spark):
    lines = ['data: {"type":"text","content":"He"}', ": ping", "data: {bad", 'data: {"type":"text","content":"y"}', "data: [DONE]", 'data: {"type":"text","content":"late"}']
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "reply string, seq int, line string")
    assert chat.replies(chat.parsed_events(rows)).first().content == "Hey"
    calls = spark.createDataFrame([("a", 0, "1", "up", "x"), ("a", 1, "2", "up", "y"), ("b", 0, "3", "none", ""), ("c", 2, "4", "bad", "")], "reply string, index int, id string, name string, arguments string")

    def bad(_):
        raise ValueError("no")

    got = {r.id: r.content for r in chat.dispatched(calls, {"up": str.upper, "bad": bad}).collect()}
    assert got == {"1": "X", "3": 'Tool "none" is not available in this session.', "4": 'Tool "bad" execution failed: no'}
    latest = spark.createDataFrame([("v", 1, "old"), ("v", 2, "new")], "view string, request int, body string")
    assert chat.latest_responses(latest).first().body == "new"
    asked = spark.createDataFrame([("p", 0, 1, "q"), ("z", 0, 1, "q")], "paper string, last_round int, last_seq int, question string")
    answers = spark.createDataFrame([("p", "a", 3, 4)], "paper string, content string, prompt int, completion int")
    assert sorted((r.paper, r.seq, r.role, r.tokens) for r in chat.answered(asked, answers).collect()) == [("p", 2, "user", 0), ("p", 3, "assistant", 7), ("z", 2, "user", 0)]


def test_actions(spark):
    acts = spark.createDataFrame([("1", "activate"), ("2", "activate"), ("3", "like")], "id string, action string")
    table = spark.createDataFrame([("1", 0), ("2", 1), ("3", 0)], "id string, status int")
    assert [r.id for r in status.ingests(acts, table).collect()] == ["1"]
    assert [r.s for r in acts.select(status.action_status(F.col("action")).alias("s")).collect()] == [1, 1, 2]


def test_schedule(spark):
    now = datetime(2024, 1, 1, 9, 0)
    assert jobs.due(now, "09:00", "2023-12-31")
    assert not jobs.due(now, "09:00", "2024-01-01")
    assert not jobs.due(now, "09:01", "")
    assert not jobs.due(now, "09:00", "", enabled=False)
    ticks = spark.createDataFrame([(datetime(2024, 1, 1, 8, 0),), (datetime(2024, 1, 1, 16, 0, 30),), (datetime(2024, 1, 1, 16, 1),)], "now timestamp")
    done = spark.createDataFrame([("2024-01-01", "08:00")], "day string, slot string").withColumn("day", F.to_date("day"))
    assert [r.slot for r in jobs.due_slots(ticks, ["08:00", "16:00"], done).collect()] == ["16:00"]
    flight = jobs.SingleFlight()
    assert flight.run(lambda: None)
    assert flight.run(lambda: None)
    assert not [x for x in [flight.run(lambda: flight.run(lambda: None) and pytest.fail("ran twice"))] if not x]


def test_retries():
    waits, calls = [], []

    def failing(error, times):
        calls.clear()

        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "ok"

        return call

    assert jobs.with_retries(failing(OSError("i/o timeout"), 3), sleep=waits.append) == "ok"
    assert [round(w * 2) for w in waits] == [1, 2, 4]
    assert all(0.5 * 2**i <= w <= 0.625 * 2**i for i, w in enumerate(waits))
    assert jobs.with_retries(failing(TimeoutError("read timed out"), 1), sleep=waits.append) == "ok"
    with pytest.raises(OSError, match="broken pipe"):
        jobs.with_retries(failing(OSError("broken pipe"), 4), sleep=waits.append)
    assert len(calls) == 4
    fresh = []
    for text in ("code 99991663", "Invalid Access Token"):
        assert jobs.with_retries(failing(OSError(text), 1), refresh=lambda: fresh.append(1)) == "ok"
    assert fresh == [1, 1]
    with pytest.raises(OSError, match="99991663"):
        jobs.with_retries(failing(OSError("99991663"), 2))

    def no_refresh():
        raise ValueError("no")

    with pytest.raises(OSError, match="99991663"):
        jobs.with_retries(failing(OSError("99991663"), 1), refresh=no_refresh)
    assert len(calls) == 1
    with pytest.raises(OSError, match="other"):
        jobs.with_retries(failing(OSError("other"), 1))
    assert len(calls) == 1


def test_errors_are_told_alike_in_columns_and_exceptions(spark):
    texts = ["Invalid Access Token", "99991663 x", "connection reset by peer", "broken pipe", "i/o timeout", "connection refused", "Connection Reset", "no"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.is_token_error(F.col("t")).alias("a"), text.is_network_error(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(text.token_error(t), text.network_error(t)) for t in texts]
    assert [r.a for r in rows].count(True) == 2
    assert [r.b for r in rows].count(True) == 4
