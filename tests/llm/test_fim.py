import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm.fim import fill_in_middle, hash_groups, restored

DOCS = "doc_id long, text string, form string, row int"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def found(spark, docs, size):
    a, b, kind, order = hash_groups(F.col("doc_id"))
    rows = fill_in_middle(spark.createDataFrame([(*d, "old", 1) for d in docs], DOCS), a, b, kind % 100 >= 90, order % 100 < 20, size=size)
    assert rows.columns == ["doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    return rows.withColumn("back", restored(F.col("output"), F.col("form")))


def sides(rows, docs):
    got = sorted((str(r.doc_id), str(r.text), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in rows.collect())
    return got, sorted((str(i), str(t), brute(i, t)) for i, t in docs)


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 16])
def test_equals_brute_force_at_any_size_of_chunk(spark, size):
    r = random.Random(size)
    pieces = ["a", "Bc", "xyz", " ", "\n", "é", "漢", "😀", "<", ">", "<S", "1", "ſ", "K"]
    text = lambda n: "".join(r.choice(pieces) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 2, 9, 40]))) for i in range(90)] + [(200, None), (201, ""), (202, "a<P>b"), (203, "<"), (204, "letters" * 30), (205, "é" * 30)]
    got, want = sides(found(spark, docs, size), docs)
    assert got == want
    assert {x[2][1] for x in got} == {"plain", "psm", "spm"}


def test_repeated_rows_missing_ids_and_long_texts(spark):
    long = "word, é " * 40_000
    docs = [(1, long), (1, long), (1, long + "x"), (None, long), (None, "short text"), (None, None), (2, "z" * 300_000), (3, "ab ab"), (3, "ab ab")]
    got, want = sides(found(spark, docs, 1 << 16), docs)
    assert got == want


def test_empty_table(spark):
    assert found(spark, [], 10).collect() == []


def test_only_long_texts_are_dealt_out(spark):
    plan = found(spark, [(1, "a b")], 1 << 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    rows = found(spark, [(i, "a b " * 10) for i in range(20)], 1 << 16)
    assert rows.count() == 20
