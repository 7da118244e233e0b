import random
from functools import cache

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from feedloom.llm import queries
from feedloom.llm.tokencount import MARK, Vocabulary, read_pieces, token_counts

PIECES = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    rows = [("<unk>", 0.0), *[(f"<0x{b:02X}>", min(PIECES.values())) for b in range(256)], *PIECES.items()]
    return Tokenizer(models.Unigram(rows, unk_id=0, byte_fallback=True))


def counted(library, text):
    return len(library.encode(MARK + text.replace(" ", MARK), add_special_tokens=False).ids) if text else 0


def test_testdata_equals_the_library(spark, library):
    at = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, at).collect()}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        assert got[r.doc_id] == counted(library, r.text)


def test_odd_texts_equal_the_library(spark, library):
    r = random.Random(2)
    texts = [None, "", " ", "   a  b ", "\n\n x\ty", "日本語 ßéñ 👩‍👩‍👧", "a" * 5000, "x▁y", "=" * 300]
    texts += ["".join(r.choice("abe tion\n日.É") for _ in range(r.randrange(200))) for _ in range(200)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] * 2
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PIECES).collect()
    assert len(got) == 2 * len(texts)
    for row in got:
        assert row.n_tokens == counted(library, texts[row.doc_id] or ""), texts[row.doc_id]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_ties_by_definition(seed):
    r = random.Random(seed)
    pieces = {"".join(r.choice("abc") for _ in range(r.randrange(1, 4))): float(-r.randrange(1, 4)) for _ in range(8)}
    vocabulary = Vocabulary(pieces)
    text = "".join(r.choice("abcé") for _ in range(30))

    @cache
    def best(end):
        if not end:
            return 0.0, 0
        options = [(best(s)[0] + pieces[text[s:end]], best(s)[1] + 1) for s in range(end) if text[s:end] in pieces]
        if text[end - 1] not in pieces:
            options.append((best(end - 1)[0] + min(pieces.values()) - 10, best(end - 1)[1] + len(text[end - 1].encode())))
        return max(options, key=lambda o: o[0])  # the first of equal ones: the earliest begin

    assert vocabulary.solve(text) == best(len(text))[::-1]
