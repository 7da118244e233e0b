import random
import re
from itertools import combinations

import pytest

from feedloom.llm.jaccard import jaccard_components, one_of_each

SCHEMA = "doc_id long, text string, lang string, node string"


def brute(rows, width, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if len(words) >= width:
            sets[doc_id] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        else:
            sets[doc_id] = {tuple(words)} if words else set()
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {d: (len(s), top(d)) for d, s in sets.items()}


def made(seed, n):
    r = random.Random(seed)
    vocabulary = [f"W{i}" if i % 3 else f"é{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 12, 40, 150, 400]))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words), "en", "x"))
    return rows + [(n, None, "en", None), (n + 1, "", None, "x"), (n + 2, " \n", "en", "x"), (n + 3, "Same", "en", "x"), (n + 4, "sAME", "en", "x")]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    rows = made(width, 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(20):
        words[i * 9] = f"new{i}"
        rows.append((100 - i, " ".join(words), "en", "x"))
    want = brute(rows, 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()}
    assert got == want
    assert {c for _, c in got.values()} == {81}


def test_testdata_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, 90).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", "en", "x")] * 2 + [(None, "a b c d e f", "en", "x"), (5, None, None, None), (5, None, None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("5", 0, 5), ("5", 0, 5), ("None", 2, 1)]


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g", "en", "x"), (2, "a b c d e f g", "de", "y"), (9, "", "en", "z"), (8, None, "en", "z"), (7, "other words", "en", "z")]
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9]


def near(words, *at):
    return " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))


def test_null_id_as_pivot(spark):
    rows = []
    for g in range(6):  # whichever of a group is the pivot, in some it is the row without an id
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(10 * g + 1, near(words, 60), "en", "x"), (10 * g + 2, near(words, 140), "en", "x"), (None, near(words), "en", "x")]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.component_id, str(r.doc_id)) for r in got) == sorted((10 * g + 1, i) for g in range(6) for i in (str(10 * g + 1), str(10 * g + 2), "None"))


def test_a_repeated_row_and_a_null_id_together(spark):
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(200)]
        one, two = near(words), near(words, 30, 70, 110, 150)  # 20 differences a side of 196: twice as many would not link
        rows = [(1, one, "en", "x"), (1, one, "en", "x"), (2, two, "en", "x"), (None, near(words, 195), "en", "x")]
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
        assert {r.component_id for r in got} == {1}


def test_group_of_many_near_copies_with_insertions_and_deletions(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    pool, rows = [[r.choice(vocabulary) for _ in range(120)]], []
    for i in range(250):
        words = list(r.choice(pool))
        for _ in range(r.choice([1, 3, 4, 5, 6, 8])):
            at, kind = r.randrange(len(words)), r.random()
            if kind < 0.6:
                words[at] = r.choice(vocabulary)
            elif kind < 0.9:
                del words[at : at + r.choice([1, 1, 8])]
            else:
                words.insert(at, r.choice(vocabulary))
        if r.random() < 0.3:
            pool.append(words)
        rows.append((i, " ".join(words), "en", "x"))
    passage = [r.choice(vocabulary) for _ in range(60)]
    for i in range(250, 350):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 60))]
        rows.append((i, " ".join(words[:9] + passage + words[9:]), "en", "x"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(spark.createDataFrame(rows, SCHEMA), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
