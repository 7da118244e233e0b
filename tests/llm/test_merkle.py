import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from feedloom.llm import merkle, queries
from feedloom.llm.merkle import folded, leaf_digest, manifest, proof_digest, traversed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, proof int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climbed(nodes):
    """The root, and each node's siblings (left, right) from the lowest level up."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, i in zip(paths, where, strict=True):
            path.append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
        where = [i // 16 for i in where]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r, leaf(r, r["text"])))
    order = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (order(x[0]["doc_id"]), x[1]))
    trees = {s: climbed([x[1] for x in by[s]]) for s in sources}
    root, above = climbed([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for (r, own), path in zip(by[s], trees[s][1], strict=True):
            steps = path + above[k]
            d = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                d = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in steps:
                d = sha(left + d + right)
            out.append((str(r["doc_id"]), own, trees[s][0], root, sha("".join(a + b for a, b in steps)), d, d == root))
    return sorted(out)


def found(spark, rows, height=merkle.HEIGHT):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 7) for r in rows], DOCS)
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, digest(lower))
    leaves = docs.select("doc_id", "source", "proof", digest(F.col("text")).alias("leaf"), changed.alias("changed"))
    out = manifest(leaves, "source", ["doc_id"], height=height)
    assert out.columns == ["doc_id", "source", "leaf", "changed", "subroot", "root", "proof"]
    out = out.withColumn("d", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.p, r.d, r.d == r.root) for r in out.withColumn("p", proof_digest(F.col("proof"))).collect())


def corpus(sizes, seed=1):
    r = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "Abc É", "x" * r.randrange(50), "TEXT\n" * r.randrange(3)])
            rows.append({"doc_id": len(rows), "text": text, "lang": r.choice(["en", None]), "source": source, "n_chars": r.choice([None, 5])})
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [1, 2, 3])
def test_equals_brute_force(spark, height):
    rows = corpus({"a": 1, "b": 16, "é": 17, None: 40, "": 257, "B": 300})
    assert found(spark, rows, height) == brute(rows)


def test_many_groups_and_a_lone_one(spark):
    rows = corpus({f"s{i}": 1 + i % 2 for i in range(40)})
    assert found(spark, rows) == brute(rows)
    one = corpus({"only": 1})
    got = found(spark, one)
    assert got == brute(one)
    assert got[0][1] == got[0][2] == got[0][3]
    assert got[0][4] == sha("")
    lone = corpus({None: 33})
    assert found(spark, lone) == brute(lone)


def test_repeated_rows_missing_ids_and_long_texts(spark):
    rows = corpus({"a": 20, None: 5})
    same = {"doc_id": 3, "text": "Same", "lang": None, "source": "a", "n_chars": 1}
    rows += [dict(same) for _ in range(40)] + [same | {"doc_id": None, "text": t} for t in ("A", "b", None)] + [same | {"doc_id": 900, "text": "Long É " * 100_000}]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_query_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in queries.op13_merkle_manifest(spark, at).collect())
    rows = [r.asDict() for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert got == brute(rows)
    assert {x[-1] for x in got} == {True, False}


def test_traversal_returns_siblings_from_the_leaf_up():
    digests = [sha(str(i)) for i in range(300)]
    root, paths = traversed(digests, 3)
    assert (root, [[tuple(s) for s in p] for p in paths]) == climbed(digests)
