import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.operators.render import sse
from feedloom.plans.fixtures import articles
from feedloom.schema import ARTICLE
from feedloom.streaming import jobs, outbox

AT = "/root/testdata/sf0.001"
NOW = "2024-05-01 08:00:00"


def rows_of(spark, n):
    rows = [{"id": f"{i:03d}", "title": f"t{i}", "abstract": "x" * 300, "recommend_date": "2024-01-01", "batch_order": i} for i in range(n)]
    return spark.createDataFrame([tuple(r.get(f.name) if f.name != "recommend_date" else None for f in ARTICLE) for r in rows], ARTICLE).withColumn("recommend_date", F.lit("2024-01-01").cast("date"))


def ids(spark, path):
    found = outbox.delivered(spark, str(path), jobs.SENT).collect()
    return [i for r in sorted(found, key=lambda r: (r["commit"], r.page)) for i in r.ids.split(",")]


def test_a_failing_batch_waits_and_none_comes_twice(spark, tmp_path):
    path, seen, down = str(tmp_path / "out"), tmp_path / "seen", tmp_path / "down"
    down.write_text("020")

    def send(key, card):
        with seen.open("a") as f:
            f.write(card["ids"].split(",")[0] + "\n")
        if down.exists() and down.read_text() in card["ids"].split(","):
            raise OSError("down")

    outbox.register(spark, send, "cards")
    store = rows_of(spark, 35)
    with pytest.raises(Exception, match="down"):
        jobs.drained(store, path, size=10, per_card=4, format="cards")
    assert sorted(ids(spark, path)) == [f"{i:03d}" for i in range(20)]  # batch 3 failed, 4 never began
    assert {x for x in seen.read_text().split() if x > "020"} == set()
    marked = jobs.marked(store, path, F.lit(NOW).cast("timestamp"))
    assert marked.where("pushed_at is not null").count() == 20
    down.unlink()
    assert jobs.drained(store, path, size=10, per_card=4, format="cards") == 15
    assert sorted(ids(spark, path)) == [f"{i:03d}" for i in range(35)]
    assert jobs.drained(store, path, size=10, per_card=4, format="cards") == 0
    assert jobs.pending(store, path).count() == 0
    pages = outbox.delivered(spark, path, jobs.SENT).where("ids like '%000%'").first()
    assert (pages.page, pages.pages, pages.ids) == (1, 3, "000,001,002,003")
    order = [x for x in seen.read_text().split()]
    assert order[:3] == ["000", "004", "008"]


def test_stream_fails_in_its_third_batch_and_goes_on(spark, tmp_path):
    source, path, down = tmp_path / "in", str(tmp_path / "out"), tmp_path / "down"
    source.mkdir()
    down.touch()
    for i in range(5):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"id": 10 * i + j}) for j in range(10)))
        os.utime(source / f"{i}.json", (1_700_000_000 + i,) * 2)

    def send(key, row):
        if down.exists() and row["id"] == 25:
            raise OSError("down")

    outbox.register(spark, send, "numbers")

    def run():
        rows = spark.readStream.schema("id int").option("maxFilesPerTrigger", 1).json(str(source))
        rows.writeStream.format("numbers").option("path", path).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="down"):
        run()
    assert sorted(r.id for r in outbox.delivered(spark, path, "id int").collect()) == list(range(20))
    down.unlink()
    run()
    run()
    assert sorted(r.id for r in outbox.delivered(spark, path, "id int").collect()) == list(range(50))
    assert outbox.commits(spark, path).select("commit").distinct().count() == 5


def test_a_batch_with_a_known_key_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    outbox.register(spark)
    for _ in range(2):
        spark.range(10).write.format("outbox").option("path", path).option("commit", "one").mode("append").save()
    assert outbox.delivered(spark, path, "id long").count() == 10
    staged = [f for f in os.listdir(f"{path}/staged")]
    assert len(staged) == outbox.commits(spark, path).count()
    assert outbox.delivered(spark, str(tmp_path / "none"), "id long").count() == 0


def test_events_are_delivered_as_text(spark, tmp_path):
    path = str(tmp_path / "out")
    outbox.register(spark)
    sse(spark.createDataFrame([("chunk", "é\n"), ("done", None)], "type string, content string")).coalesce(1).write.format("outbox").option("path", path).option("raw", "event").mode("append").save()
    name = outbox.commits(spark, path).first()["file"]
    assert open(f"{path}/staged/{name}").read() == 'data: {"type":"chunk","content":"é\\n"}\n\ndata: {"type":"done"}\n\n'


def test_a_real_backlog_goes_out_whole(spark, tmp_path):
    path, store = str(tmp_path / "out"), articles(spark, AT)
    outbox.register(spark)
    want = [r.id for r in store.where("pushed_at is null and recommend_date is not null").orderBy("recommend_date", F.asc_nulls_first("batch_order"), "id").collect()]
    assert jobs.drained(store, path, size=16) == len(want) > 32
    assert ids(spark, path) == want
    assert jobs.marked(store, path, F.lit(NOW).cast("timestamp")).where("recommend_date is not null and pushed_at is null").count() == 0
