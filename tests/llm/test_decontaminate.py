import hashlib
import random
import re

import pytest

from feedloom.llm import decontaminate, queries
from feedloom.llm.decontaminate import benchmark_hits, clean_of_benchmark

DOCS = "doc_id long, text string, items string, n_words string"
ITEMS = "item_id long, text string, spans int"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, width=13):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item_id))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    own |= windows[key]
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(own), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def judged(hits):
    return {
        r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        for r in hits.collect()
    }


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(1)
    vocabulary = ["Aa", "b", "É", "x9", "zz", "c", "d"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 5, 13, 14, 30, 0]))) for i in range(25)] + [(90, None), (91, "")]
    docs = [(i, text(r.choice([0, 3, 40, 200])) + r.choice(items)[1].__str__() * r.randrange(2) + " " + text(5)) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "?!")]
    hits = benchmark_hits(spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    assert judged(hits) == brute(docs, items)


def test_testdata_equals_brute_force(spark):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_benchmark_decontamination(spark, at).collect()}
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{at}/{t}.parquet").collect()]
    want = brute(read("documents"), read("benchmark"))
    assert any(w[4] for w in want.values())
    assert got == want


def test_a_hit_over_two_windows_is_merged_and_clean_documents_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {item} y", "a", "b"), (2, "w0 w1 w2", "a", "b"), (3, None, "a", "b"), (1, "other row", "a", "b")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item, 1)], ITEMS)
    first = benchmark_hits(d, b).where("doc_id = 1 and n_words = 22").first()
    assert (first.n_hit, first["items"], list(memoryview(first.spans).cast("q"))) == (20, ["7"], [1, 21])
    kept = clean_of_benchmark(d, b)
    assert kept.columns == ["doc_id", "text", "items", "n_words"]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "other row"), (2, "w0 w1 w2"), (3, "")]


def test_rows_without_an_id_and_repeated_rows_are_judged_by_their_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item, "a", "b"), (None, "clean", "a", "b"), (4, item, "a", "b"), (4, item, "a", "b"), (5, item * 3000, "a", "b")], DOCS)
    kept = clean_of_benchmark(docs, spark.createDataFrame([(7, item, 1)], ITEMS))
    assert [tuple(r) for r in kept.collect()] == [(None, "clean", "a", "b")]
    assert clean_of_benchmark(docs.limit(0), spark.createDataFrame([], ITEMS)).collect() == []


def test_empty_tables(spark):
    none, item = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert benchmark_hits(none, item).collect() == []
    hits = benchmark_hits(spark.createDataFrame([(1, "a b", "", "")], DOCS), item).collect()
    assert [(r.n_words, r.n_hit) for r in hits] == [(2, 0)]
