import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm.linededup import LineRuns, deduplicated_lines

DOCS = "doc_id long, text string, n_lines string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, least_docs=3, least_chars=20):
    held = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        own = lambda k: held[k] - {None}
        kept = [x for x in lines if not (len(key(x)) >= least_chars and len(own(key(x))) >= least_docs and max(own(key(x))) != doc_id)]
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def found(spark, docs, **more):
    rows = deduplicated_lines(spark.createDataFrame([(*d, "old") for d in docs], DOCS), **more)
    assert rows.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in rows.collect())


def corpus(n=120):
    r = random.Random(3)
    long = [f"{'aé'[i % 2]} common line number {i} " + "x" * (i % 5) for i in range(25)] + ["y" * 19, "z" * 20, "É" * 20, "é" * 20]
    vary = lambda x: r.choice(["", " ", "\t\r"]) + r.choice([x, x.upper() if x.isascii() else x]) + r.choice(["", " ", "\x0b"])
    text = lambda: "\n".join(vary(r.choice(long)) if r.random() < 0.6 else f"own line {r.random()} of this one" * r.randrange(2) for _ in range(r.randrange(12)))
    return [(i, text()) for i in range(n)]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_equals_brute_force_however_it_is_dealt(spark, batches, fanout):
    docs = [*corpus(), (500, None), (501, ""), (502, "\n\n")]
    assert found(spark, docs, batches=batches, fanout=fanout) == brute(docs)


def test_repeated_ids_missing_ids_ties_and_long_texts(spark):
    a, b = "this line is long enough", "and so is this other line"
    docs = [(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (1, f"{b}\nx"), (2, f"{a}\n{a}"), (None, f"{a}\n{b}"), (None, f"q\n{a}"), (3, a), (3, "\n".join([a, b] * 5000)), (4, b)]
    got = found(spark, docs)
    assert got == brute(docs)
    assert [x[3] for x in got if x[0] == "None"] == [2, 1]  # without an id no line is held
    assert [x[3] for x in got if x[2] == 10_000] == [5000]  # 3 holds a, 4 holds b
    few = [(1, a), (2, a), (2, a), (None, a)]
    assert found(spark, few) == brute(few)
    assert {x[3] for x in found(spark, few)} == {0}  # two documents


def test_empty_table(spark):
    assert found(spark, []) == []


def test_runs_are_compacted_and_hold_each_key_once(spark):
    runs = LineRuns(spark, fanout=2)
    batch = lambda i: spark.createDataFrame([(h, -h, 1, 100 - i) for h in range(i, i + 4)], "h long, g long, n long, holder long")
    for i in range(5):
        runs.add(batch(i))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    tables = [x for level in runs.levels for x in level]
    rows = {r.h: (r.n, r.holder) for r in runs.merged().collect()}
    assert rows == {h: (len([i for i in range(5) if i <= h < i + 4]), 100 - max(0, h - 3)) for h in range(8)}
    assert sum(spark.table(x).where("holder is not null").count() for x in tables) == 8
    runs.drop()
    assert not any(spark.catalog.tableExists(x) for x in tables)


def test_runs_do_not_move_when_a_batch_is_joined(spark, monkeypatch):
    runs, plans = LineRuns(spark), []
    put = LineRuns._put

    def seen(self, level, rows):
        plans.append(rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))
        put(self, level, rows)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs.add(spark.range(100).select(F.col("id").alias("h"), F.col("id").alias("g"), F.lit(1).alias("n"), F.lit(5).alias("holder")))
        monkeypatch.setattr(LineRuns, "_put", seen)
        keys = spark.range(50, 150).groupBy(F.col("id").alias("h"), F.col("id").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.lit(4).alias("holder"))
        runs.add(keys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plans[0]
    assert plans[0].count("Exchange") == 1  # the batch's own
    runs.drop()


def test_places_of_a_digest(spark):
    docs = corpus(20)
    got = {r.doc_id: r.d for r in deduplicated_lines(spark.createDataFrame([(*d, "") for d in docs], DOCS)).select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert got == {int(i): hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in brute(docs)}
