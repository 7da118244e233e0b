import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.llm import lm, queries
from feedloom.llm.lm import GAIN, SUPPORT, WEIGHT, lm_scores, longer


def symbols(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


def base(rows):
    """rows: (doc_id, text, held_out)."""
    count = Counter(w for _, t, h in rows if not h for w in symbols(t))
    n, v = sum(count.values()), len(count)
    out = {}
    for i, t, h in rows:
        w = symbols(t)
        out[i] = (h, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


def suffix_scores(rows):
    """The log10 probability of each text by the suffix tree, from dictionaries of whole contexts."""
    texts = [(i, ["<begin>", *symbols(t)], h) for i, t, h in rows]
    count = Counter(w for _, t, h in texts if not h for w in t[1:])
    n, v = sum(count.values()), len(count)
    p = {(x, j): (count[t[j]] + 0.1) / (n + 0.1 * (v + 1)) for x, (_, t, _) in enumerate(texts) for j in range(1, len(t))}
    live, length, deepest = set(p), 1, 0
    while live:
        pairs, total = Counter(), Counter()
        context = {(x, j): tuple(texts[x][1][j - length : j]) for x, j in live if j >= length}
        for (x, j), c in context.items():
            if not texts[x][2]:
                pairs[c, texts[x][1][j]] += 1
                total[c] += 1
        smooth = {a: (pairs[c, texts[a[0]][1][a[1]]] + WEIGHT * p[a]) / (total[c] + WEIGHT) for a, c in context.items() if total[c] >= SUPPORT}
        gain, own, under = defaultdict(float), defaultdict(float), defaultdict(float)
        for a, q in smooth.items():
            if not texts[a[0]][2]:
                n = pairs[context[a], texts[a[0]][1][a[1]]]
                gain[context[a]] += math.log((n - 1 + WEIGHT * p[a]) / (total[context[a]] - 1 + WEIGHT) / p[a])
                own[context[a]] -= math.log(q)
                under[context[a]] -= math.log(p[a])
        live = set()
        for a, q in smooth.items():
            c = context[a]
            kept = gain[c] >= GAIN
            if (own[c] if kept else under[c]) >= GAIN:
                live.add(a)
            if kept:
                p[a], deepest = q, max(deepest, length)
        length = longer(length)
    return {i: sum(math.log10(p[x, j]) for j in range(1, len(t))) for x, (i, t, _) in enumerate(texts)}, deepest


def test_testdata_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    want, got = base(rows), {r.doc_id: r for r in queries.op9_lm_scoring(spark, at).collect()}
    score, deepest = suffix_scores(rows)
    assert len(got) == len(want) and deepest > 1
    for i, w in want.items():
        assert tuple(got[i])[1:5] == w[:4]
        assert got[i].base_score == pytest.approx(w[4], abs=1e-6)
        assert got[i].score == pytest.approx(score[i], rel=1e-5, abs=1e-4)
    # held-out texts are likelier than by single words
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_long_contexts_equal_brute_force(spark):
    # one text of a few that many rows repeat with rare changes: deep contexts have several successors
    words = [f"w{i * i % 37}" for i in range(120)]
    rows = []
    for i in range(120):
        own = list(words)
        if i % 3 == 0:
            own[i % 100 + 10] = f"x{i % 5}"
        rows.append((i, " ".join(own[i % 7 :]), i % 10 == 0))
    rows += [(1000 + i, f"{c} same words follow here now, {e}", i % 20 == 0) for i, (c, e) in enumerate([("a", "x"), ("b", "y")] * 100)]
    score, deepest = suffix_scores(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(5)
    got = {r.doc_id: r.score for r in lm_scores(docs, F.col("h")).collect()}
    assert deepest >= 8
    assert all(got[i] == pytest.approx(score[i], rel=1e-5, abs=1e-4) for i in score)


def test_nulls_empty_tables_and_repeated_rows(spark):
    rows = [(1, "a b b", "x"), (1, "a b b", "x"), (2, None, None), (3, "", "y"), (None, "C c", "z"), (4, "b " * 900, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = lm_scores(docs, F.col("doc_id") == 3).collect()
    numbered = [(k, t, i == 3) for k, (i, t, _) in enumerate(rows)]
    want, score = base(numbered), suffix_scores(numbered)[0]
    key = lambda x, s: (x[0], *x[1:4], round(x[4], 6), round(s, 2))
    assert sorted(key(tuple(r)[1:6], r.score) for r in got) == sorted(key(w, score[k]) for k, w in want.items())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(none, F.lit(False)).collect() == []


def test_result_does_not_depend_on_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once = {r.doc_id: r.score for r in lm_scores(docs.coalesce(1), F.col("doc_id") % 7 == 0).collect()}
    dealt = {r.doc_id: r.score for r in lm_scores(docs.repartition(7), F.col("doc_id") % 7 == 0).collect()}
    assert once == pytest.approx(dealt, abs=1e-9)


def test_states_are_not_shuffled_and_asks_get_fewer_parts(spark, monkeypatch):
    from feedloom.llm import lm

    plans, answered, write = [], [], lm.written

    def watched(df, name, by=None, buckets=None):
        if buckets:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        else:
            answered.append(df.rdd.getNumPartitions())
        return write(df, name, by, buckets)

    monkeypatch.setattr(lm, "written", watched)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 14)
    assert lm_scores(docs, F.col("doc_id") % 7 == 0).count() == docs.count()
    assert len(plans) > 4 and all(p.count("Exchange") == 1 for p in plans[1:])  # that of the answers
    assert answered[0] > 4 and answered[-1] == 4


def test_distinct_of_keys_that_share_their_high_bits():
    import numpy as np

    from feedloom.llm.lm import _distinct

    keys = np.array([3, 1 << 40, 2, 3, 1, 1 << 40, 2, 0], np.uint64)
    known, place = _distinct(keys)
    assert known.tolist() == [0, 1, 2, 3, 1 << 40] and known[place].tolist() == keys.tolist()
    none = _distinct(keys[:0])
    assert len(none[0]) == len(none[1]) == 0


def test_pairs_of_words_are_asked_by_numbers_and_in_rounds(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(300)), i % 10 == 0) for i in range(400)]
    pairs = len({x for _, t, _ in rows for x in zip(t.split(), t.split()[1:], strict=False)})
    asked, rounds, begun = [], [], lm._Step.__init__

    def told(self, *args):
        begun(self, *args)
        asked.append(self.asked)
        rounds.append(self.rounds)

    monkeypatch.setattr(lm._Step, "__init__", told)
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)
    scores = lambda: sorted(tuple(x) for x in lm_scores(docs, F.col("held_out")).collect())
    want = scores()
    assert asked[1] < 4 * pairs  # 64-bit hashes take 6 bytes or more
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert scores() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(rounds) > 1
    brute = suffix_scores(rows)[0]
    assert all(abs(x[-1] - brute[x[0]]) < 1e-3 for x in want)


def test_texts_are_written_once_and_asks_of_short_contexts_nowhere(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(300)), i % 10 == 0) for i in range(400)]
    pairs = len({x for _, t, _ in rows for x in zip(t.split(), t.split()[1:], strict=False)})
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)
    kinds, asked, write, asks = [], [], lm.written, lm._Step.asks

    def watched(df, name, by=None, buckets=None):
        out = write(df, name, by, buckets)
        if buckets:
            packs = out.select("kind", "pack").toArrow()
            kinds.append({k: set(lm._unpacked(p)) for k, p in zip(packs["kind"].to_pylist(), packs["pack"], strict=True)})
        return out

    def counted(self, x):
        out = asks(self, x)
        asked.append((self.k, out.select(F.sum(F.length("pack"))).first()[0] or 0))
        return out

    monkeypatch.setattr(lm, "written", watched)
    monkeypatch.setattr(lm._Step, "asks", counted)
    got = {x.doc_id: x.score for x in lm_scores(docs, F.col("held_out")).collect()}
    assert "place" in kinds[0]["texts"]
    assert all(set(x) <= {"state", "done"} and "place" not in x["state"] for x in kinds[1:5])
    assert "place" in kinds[-1]["done"]
    assert 0 < sum(n for k, n in asked if k == 0) < 4 * pairs
    want = suffix_scores(rows)[0]
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_asks_of_all_rounds_are_those_of_one(spark):
    import numpy as np
    import pyarrow as pa

    from feedloom.llm.lm import _END, _asks, _rooted, _taken, _unpacked

    r = np.random.default_rng(7)
    size = np.full(40, 60)
    words = np.sort(r.integers(0, 1 << 63, 8, dtype=np.uint64))
    place = np.concatenate([np.concatenate([[0], 1 + r.integers(0, 8, 60), [0]]) for _ in size]).astype(np.uint32)
    known = np.append(_END, words)
    by = np.argsort(known)
    rank = np.empty(9, np.uint32)
    rank[by] = np.arange(9, dtype=np.uint32)
    state = {"place": place, "size": size, "learn": np.arange(40) % 5 > 0, "rank": np.diff(rank, prepend=np.uint32(0))}
    learnt = np.repeat(state["learn"], 62) & np.tile(np.arange(62) > 0, 40)
    count = np.bincount(place[learnt], minlength=9)
    got = {"word": count[by], "number": np.arange(9, dtype=np.uint64), "most": np.array([9])}
    stream = _rooted(state, got, np.array([count.sum(), (count > 0).sum()]))
    parts, length = 7, 0
    for k in range(3):
        _taken(state, stream, got, k, length, parts)
        whole = list(_asks(parts, stream, state, k, length))
        rounds = [x for part in (0, 4) for x in _asks(parts, stream, state, k, length, part, min(4, parts - part))]
        assert whole and sorted(whole) == sorted(rounds)
        got = {}
        for _, kind, pack in sorted(whole, key=lambda x: x[0]):
            own = _unpacked(pa.scalar(pack, pa.binary()))
            got.setdefault(kind, []).append(own["n"] if kind == "count" else np.full(len(own["gain"]), 2, np.uint8))
        got = {c: np.concatenate(x) for c, x in got.items()}
        length = length + 1


def test_two_words_in_test_are_a_key_of_their_numbers():
    import numpy as np

    from feedloom.llm.lm import _Stream

    state = {"known": np.arange(9, dtype=np.uint32), "place": np.array([0, 1, 2, 1, 2, 0], np.uint32), "size": np.array([4]), "learn": np.array([1]), "words": np.array([9])}
    keys, bits = _Stream(state).tested(np.array([3, 4, 5]), 2)
    assert bits == 8 and keys[0] == keys[2] != keys[1]


def test_later_states_hold_what_live_places_need(spark, monkeypatch):
    # a text that rows repeat with rare changes has contexts of many words, the others have not
    r = random.Random(11)
    rows = []
    for i in range(120):
        own = [f"w{j * j % 37}" for j in range(120)]
        if i % 3 == 0:
            own[i % 100 + 10] = f"x{i % 5}"
        rows.append((i, " ".join(own[i % 7 :]), False))
    rows += [(1000 + i, " ".join(f"n{r.randrange(40)}" for _ in range(200)), False) for i in range(200)]
    held, write = [], lm.written

    def watched(df, name, by=None, buckets=None):
        out = write(df, name, by, buckets)
        if buckets:
            packs = [lm._unpacked(p) for p in out.where("kind = 'state'").select("pack").toArrow()["pack"]]
            held.extend(len(p["place"]) for p in packs if "place" in p)
        return out

    monkeypatch.setattr(lm, "written", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)
    got = {x.doc_id: x.score for x in lm_scores(docs, F.col("held_out")).collect()}
    assert held and max(held) <= 120 * 122  # all symbols are some 200 * 202 more
    want = suffix_scores(rows)[0]
    assert all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_tasks_leave_imports_out_of_garbage_collection(spark):
    def run(batches):
        import gc

        import pyarrow as pa

        list(lm._totals(iter(())))
        yield from (pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()])], names=["n"]) for _ in batches)

    assert spark.range(0, 1, 1, 1).mapInArrow(run, "n long").first().n > 1000


def test_words_in_test_are_sorted_once_each():
    import numpy as np

    from feedloom.llm.lm import _distinct, _edges, _Stream

    r = np.random.default_rng(2)
    known = np.sort(r.choice(5000, 300, replace=False)).astype(np.uint32)
    place = np.append(r.integers(0, 300, 4001), 0).astype(np.uint32)
    stream = _Stream({"known": known, "place": place, "size": np.array([4000]), "learn": np.array([1]), "words": np.array([5000])})
    at = np.sort(r.choice(np.arange(1, 4002), 900, replace=False))
    keys, of = stream.tests(at, 1)
    want, place_of = _distinct(stream.tested(at, 1)[0])
    assert keys.tolist() == want.tolist() and of.tolist() == place_of.tolist()
    for parts in (1, 7, 51):
        part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        assert (np.searchsorted(_edges(parts), keys, "right") - 1).tolist() == part.tolist()


def test_packs_leave_out_high_bytes_that_are_zero():
    import numpy as np
    import pyarrow as pa

    from feedloom.llm.lm import _packed, _unpacked

    arrays = {
        "a": np.array([1, 255], np.uint64), "b": np.array([1 << 40, 3], np.int64), "c": np.array([-1, 2], np.int64), "d": np.array([0.5, -2.0]),
        "e": np.zeros(3, np.uint32), "f": np.zeros(0, np.int64), "g": np.array([(1 << 64) - 1, 0], np.uint64), "h": np.array([True, False]),
    }
    pack = pa.scalar(_packed(**arrays), pa.binary())
    got = _unpacked(pack)
    assert all(got[c].dtype == x.dtype and got[c].tolist() == x.tolist() for c, x in arrays.items())
    assert set(_unpacked(pack, but=("a", "d"))) == set(arrays) - {"a", "d"}
    assert b'["a", "<u8", 2, 1,' in pack.as_py()
