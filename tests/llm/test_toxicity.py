import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import queries
from feedloom.llm.toxicity import Model, held_out, not_toxic, segments, toxicity, train


def slow(score):
    """All maximal scoring segments by definition: the best one, then those left and right of it."""
    best = max(((sum(score[i:j]), -(j - i), -i, i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return slow(score[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in slow(score[j:])]


@pytest.mark.parametrize("seed", range(60))
def test_segments_by_definition(seed):
    r = random.Random(seed)
    score = [r.choice([3.0, 1.0, 2.5]) + r.random() / 64 if r.random() < 0.4 else -1.0 for _ in range(r.randrange(1, 25))]
    places = np.array([i for i, s in enumerate(score) if s > 0], np.int64)
    got = segments(places, np.array([score[i] for i in places]), 1.0)
    want = slow(score)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, at).where("held_out")
    rows = got.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 1000
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9
    assert hit / sum(r.toxic for r in rows) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    at = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (train(docs, x.where(~held_out(F.col("doc_id")))) for x in (labels, other))
    assert a.curve == b.curve
    assert a.odds.tolist() == b.odds.tolist()


def planted(spark):
    r = random.Random(5)
    bad = ["vile", "scum", "fool"]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{r.randrange(400)}".replace("0", "o") + "abc"[r.randrange(3)] * 2 for _ in range(60)]
        words = ["".join(c for c in w if c.isalpha()) + "xyz"[j % 3] + "klm"[r.randrange(3)] for j, w in enumerate(words)]
        toxic = i % 4 == 0
        if toxic:
            words[20:24] = [r.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_passages_and_the_filter(spark):
    docs, labels = planted(spark)
    model = train(docs, labels)
    found = {r.doc_id: r for r in toxicity(docs, model).collect()}
    assert all((r.score >= 0.7) == (i % 4 == 0) for i, r in found.items())
    assert all(found[i].passages[0].begin <= 20 and found[i].passages[0].end >= 24 for i in range(0, 600, 4))
    kept = not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 4}
    vile = docs.where("doc_id = 0").first().text
    odd = spark.createDataFrame([(None, vile, "a"), (None, "calm", "b"), (1, vile, "c"), (900, None, "d"), (901, "", "e")], docs.schema)
    rest = not_toxic(docs.union(odd), labels).where("score <> 'x'")
    assert sorted(r.score for r in rest.collect()) == ["b", "d", "e"]


def test_nulls_and_empty_tables(spark):
    docs, labels = planted(spark)
    odd = docs.union(spark.createDataFrame([(None, "scum", None), (700, None, None), (701, "", None), (701, "", None), (702, "vile " * 200_000, None)], docs.schema))
    got = {r.doc_id: r.score for r in toxicity(odd, train(odd, labels.union(spark.createDataFrame([(700, None, None), (None, 1, None)], labels.schema)))).collect()}
    assert got[700] == got[701] < 0.3
    assert got[702] >= 0.7
    nothing = toxicity(docs, train(docs, labels.limit(0))).collect()
    assert {round(r.score, 6) for r in nothing} == {0.0}
    assert toxicity(docs.limit(0), Model()).collect() == []
