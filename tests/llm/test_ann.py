import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann, queries, runtime
from feedloom.llm.ann import nearest, neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, vec string, node string"


def brute(rows, k=20):
    """{query: [(id, score), ...]} over valid vectors."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    vectors = np.array([good[i] for i in ids], np.float32).astype(float)
    out = {}
    for q, i in enumerate(ids):
        if i % 20 == 0:
            score = vectors @ vectors[q]
            order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(out):
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        own = got.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


def test_testdata_recall_and_exact_scores(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    got, want = found(queries.op2_nearest_neighbours(spark, at)), brute(rows)
    assert set(got) == set(want)
    assert recall(got, want) > 0.95
    for q, own in got.items():
        score = dict(brute([(i, v) for i, v in rows if i == q or i in dict(own)], 10**6)[q])
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in own)


def test_recall_through_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 100)
    monkeypatch.setattr(ann, "BLOCK_NODES", 500)
    r = np.random.default_rng(1)
    centre = r.standard_normal((8, 32))
    vectors = centre[r.integers(0, 8, 3000)] + r.standard_normal((3000, 32))
    rows = [(i, [float(np.float32(x)) for x in v], "a", "b") for i, v in enumerate(vectors)]
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert recall(got, brute([x[:2] for x in rows])) > 0.9


def test_equal_vectors_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0], "a", "b") for i in range(60)] + [(100 + i, [0.5, float(i)], "a", "b") for i in range(5)]
    rows += [(200, None, "", ""), (220, [], "", ""), (240, [0.0, 0.0], "", ""), (260, [1.0, None], "", ""), (280, [float("nan"), 1.0], "", ""), (300, [float("inf"), 1.0], "", ""), (320, [1.0, 2.0, 3.0], "", ""), (None, [1.0, 1.0], "", "")]
    rows += [(0, [1.0, 0.0], "again", "b")]
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    want = brute([(i, v if v is None or len(v) < 3 else None) for i, v, *_ in rows])
    assert got == want


def test_scores_of_doubles_are_exact_and_near_equal_vectors_differ(spark):
    r = np.random.default_rng(2)
    vectors = r.standard_normal((300, 16))
    vectors[200:] = vectors[100:200] + 1e-12  # as floats these are the same
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5))
    for q, own in got.items():
        score = vectors @ vectors[q]
        assert all(s == pytest.approx(score[i], rel=1e-15, abs=1e-15) for i, s in own)
        order = [int(j) for j in np.lexsort((np.arange(300), -score)) if j != q][:5]
        assert [i for i, _ in own] == order


def test_nothing_is_left_but_what_the_plan_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(100)]
    out = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted({x.name.split("-")[0] for x in tmp_path.iterdir()}) == ["beam", "vectors"]
    assert out.count() == 100


def test_few_rows_and_empty_table(spark):
    one = spark.createDataFrame([(20, [1.0], "", ""), (21, [2.0], "", "")], SCHEMA)
    assert found(nearest(one, F.col("vec_id") % 20 == 0)) == {20: [(21, 2.0)]}
    assert nearest(one.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbour_graph(spark.createDataFrame([(1, [1.0])], "node long, vec array<float>")).collect() == []
