import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from feedloom.llm import bpe, queries
from feedloom.llm.bpe import Ranks, decode, encode, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(3)
    out = [None, "", " ", "  \n\n  x", "a" * 3000, "ab" * 700, "=" * 2000 + "x", "\x1c \x85 é", "It's 'S we'LL 12345 ½Ⅷ", "<|endoftext|>", "日本語のテキスト" * 80, "👩‍👩‍👧 🇩🇪"]
    for _ in range(150):
        alphabet = r.choice(["ab", "abcdefghij", "the ing on\n", "éèöñßд日本 a1.", "aA0_-#$ \t"])
        out.append("".join(r.choice(alphabet) for _ in range(r.choice([3, 30, 300, 2000]))))
    return out


def test_encodes_as_the_library_and_decodes_back(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    ids = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, PATTERN)
    got = {r.doc_id: r for r in decode(ids, PATH).collect()}
    for i, text, _ in rows:
        want = library.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, text
        assert got[i].decoded.decode() == (text or "")


def test_testdata_equals_the_library(spark, library):
    at = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_byte_level_bpe(spark, at).collect()}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))


@pytest.mark.parametrize("seed", range(40))
def test_long_rows_merge_as_one_pair_at_a_time(seed):
    r = random.Random(seed)
    tokens = {bytes([b]): b for b in range(256)}
    for _ in range(60):
        a, b = r.choice([t for t in tokens if t < b"d" and t >= b"a"]), r.choice([t for t in tokens if t < b"d" and t >= b"a"])
        tokens.setdefault(a + b, len(tokens))
    ranks = [*range(256), *r.sample(range(256, len(tokens)), len(tokens) - 256)]
    vocabulary = Ranks({t: ranks[i] for t, i in tokens.items()})
    ids = vocabulary.byte[[r.choice(b"abc") for _ in range(200)]]
    slow = list(ids)
    while len(slow) > 1:
        rank = vocabulary.of(np.array(slow[:-1]), np.array(slow[1:]))
        if rank.min() == 2**31 - 1:
            break
        j = int(rank.argmin())
        slow[j : j + 2] = [rank[j]]
    assert vocabulary._long(ids).tolist() == slow
    assert vocabulary._matrix(ids[None, :].copy())[0].tolist() == slow


def test_empty_table(spark):
    ids = encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN)
    assert decode(ids, PATH).collect() == []


def test_decoding_replaces_a_column_and_refuses_unknown_ids(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(rows, ranks, public_tokenizers.PATTERN).withColumn("decoded", F.lit("old"))
    got = bpe.decode(ids, ranks)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id, bytes(r.decoded)) for r in got.collect()) == [(1, b"a b"), (2, b"")]
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "ids binary"), ranks).collect()
