import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedloom.plans import flows
from feedloom.plans.fixtures import articles
from feedloom.sources.lookup import Ticks, looked_up
from feedloom.streaming import chat, memo

AT = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(*chat.STORE)
    yield
    spark.conf.unset(chat.STORE[0])


def run(spark, tmp_path, frames, schema, make):
    at = tmp_path / "in"
    at.mkdir()
    for i, rows in enumerate(frames):
        (at / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(at / f"{i:03d}.json", (1_700_000_000 + i,) * 2)
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(at)).withWatermark("ts", "1 second"))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = q.recentProgress
    return spark.read.parquet(str(tmp_path / "out")).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_cards_are_forgotten_at_the_end_or_after_a_while(spark, tmp_path):
    ts = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    chunk = lambda card, seq, text, s, last=False: {"card": card, "seq": seq, "text": text, "last": last, "ts": ts(s)}
    frames = [
        [chunk("a", 0, "x" * 300, 0), chunk("a", 1, "end", 1, True), chunk("b", 0, "y" * 250, 1), chunk("b", 1, "left over", 2)],
        [chunk("a", 2, "too late", 3), chunk("z", 0, "z", 200)],
        [chunk("z", 1, "z", 201)],
        [chunk("b", 2, "a new life", 202, True)],
    ]
    rows, states = run(spark, tmp_path, frames, "card string, seq int, text string, last boolean, ts timestamp", lambda c: chat.patches(c, timeout=60_000))
    got = sorted((r.card, r.part, r.body) for r in rows)
    long = "y" * 250
    assert got == [("a", 0, "x" * 300), ("a", 0, "x" * 300 + "end"), ("b", 0, "a new life"), ("b", 0, long), ("b", 0, long + "left over")]
    assert max(states) > 1  # what stays: z, whose time is not over, and the new b


def test_answers_are_asked_again_after_a_day(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    asks = [("2024-02-10", 0), ("2024-02-10", 23), ("2024-02-11", 23), ("2024-02-10", 24), ("2024-02-10", 47), ("2024-02-11", 60), ("2024-02-10", 72)]
    frames = [[{"key": k, "ts": (start + timedelta(hours=h)).isoformat()}] for k, h in asks]
    log = tmp_path / "asked"

    def answer(key):
        with log.open("a") as f:
            f.write(key + "\n")
        return key[-2:]

    rows, states = run(spark, tmp_path, frames, "key string, ts timestamp", lambda a: memo.remembered(a, answer))
    hours = lambda r: int((r.ts.replace(tzinfo=timezone.utc) - start).total_seconds() // 3600)
    fresh = {(r.key, hours(r)) for r in rows if r.fresh}
    assert fresh == {("2024-02-10", 0), ("2024-02-11", 23), ("2024-02-10", 24), ("2024-02-11", 60), ("2024-02-10", 72)}
    assert len(log.read_text().split()) == len(fresh)
    assert {(r.key, r.answer) for r in rows} == {("2024-02-10", "10"), ("2024-02-11", "11")}
    table = spark.createDataFrame([(k, start + timedelta(hours=h)) for k, h in asks], "key string, ts timestamp")
    assert {(r.key, hours(r)) for r in memo.asked_anew(table).where("fresh").collect()} == fresh
    assert states


def test_lookups_keep_to_their_rate_and_equal_a_join(spark, tmp_path):
    log = str(tmp_path / "starts")

    def votes(id_):
        begun = time.time()
        time.sleep(0.15)
        with open(log, "a") as f:
            f.write(f"{begun} {time.time()}\n")
        if id_.endswith("3"):
            raise OSError("no")
        return len(id_)

    keys = spark.createDataFrame([(str(i),) for i in range(30)], "id string")
    got = looked_up(keys, {"a": votes, "b": lambda i: int(i) * 2}, in_flight=5, per_second=20).collect()
    assert sorted(tuple(r) for r in got) == sorted((str(i), None if i % 10 == 3 else len(str(i)), 2 * i) for i in range(30))
    times = sorted(tuple(map(float, x.split())) for x in open(log).read().splitlines())
    gaps = [b[0] - a[0] for a, b in zip(times, times[1:], strict=False)]
    assert sum(gaps) >= 29 * 0.05 * 0.9
    at_once = [sum(a <= t < b for a, b in times) for t, _ in times]
    assert 2 <= max(at_once) <= 5
    real = articles(spark, AT).select("id")
    found = looked_up(real, flows.VOTES, per_second=1e6, tasks=3)
    want = real.select("id", F.when(~F.endswith("id", F.lit("3")), F.length("id") % 7).alias("hf_upvotes"), F.crc32("id").cast("int").alias("x"))
    assert sorted(found.select("id", "hf_upvotes").collect()) == sorted(want.select("id", "hf_upvotes").collect())
    with pytest.raises(ValueError, match="1 to 5 tasks"):
        looked_up(real, flows.VOTES, tasks=6)


def test_ticks_are_dealt_in_order():
    now, slept = [0.0], []
    ticks = Ticks(0.5, lambda: now[0], slept.append)
    for _ in range(3):
        ticks.wait()
    assert slept == [0.5, 1.0, 1.5]
    now[0] = 10.0
    ticks.wait()
    assert slept == [0.5, 1.0, 1.5]  # ticks that passed are lost
    ticks.wait()
    assert slept[3:] == [0.5]
