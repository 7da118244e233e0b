import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from feedloom.llm import queries
from feedloom.llm.bpe import read_ranks
from feedloom.llm.toxicity import held_out, toxicity, train
from pyspark.sql import functions as F

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as groups

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, AT)
        out.append(made.collect())
        docs = spark.createDataFrame(out[-1], made.schema)
    return out


def test_every_stage_keeps_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for rows in stages[:-1]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    docs = spark.createDataFrame(stages[0])
    model = train(docs, spark.read.parquet(f"{AT}/labels.parquet").where(~held_out(F.col("doc_id"))))
    gone = {r.doc_id for r in toxicity(docs, model).collect() if r.score >= 0.7}
    assert {r.doc_id for r in stages[0]} - {r.doc_id for r in stages[1]} == gone


def test_one_of_each_group_stays(stages):
    found = groups([(r.doc_id, r.text) for r in stages[1]], 5, 80)
    assert {r.doc_id for r in stages[2]} == {top for _, top in found.values()}


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{AT}/benchmark.parquet").select("item_id", "text").collect()]
    found = contaminated([(r.doc_id, r.text) for r in stages[2]], items)
    assert {r.doc_id for r in stages[3]} == {i for i, f in found.items() if not f[4]}


def test_pseudonyms_and_token_ids(stages):
    assert [r.doc_id for r in stages[3]] == [r.doc_id for r in stages[4]]
    changed = [(a.text, b.text) for a, b in zip(stages[3], stages[4], strict=True) if a.text != b.text]
    assert changed
    assert all(len(a) == len(b) or "." in a for a, b in changed)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id for r in stages[5]} == set(text)
    for r in stages[5]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text[r.doc_id])


def test_run_equals_the_stages(spark, stages):
    got = queries.queries()["pipeline"](spark, AT).collect()
    assert {(r.doc_id, bytes(r.ids)) for r in got} == {(r.doc_id, bytes(r.ids)) for r in stages[-1]}


#: A table with more columns, of names that the operators use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, ids string, items string, n_words string, decoded string, row string"


def odd(spark, rows):
    """``rows(doc_id, text)`` beside the documents of the test table."""
    more = ["s", "c", "i", "t", "w", "d", "r"]
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *more) for r in spark.read.parquet(f"{AT}/documents.parquet").collect()]
    return spark.createDataFrame(own + [(i, t, None, None, None, *more) for i, t in rows], ODD)


LONG = " ".join(f"word{i}" for i in range(120_000))
EDGES = [(900_001, None), (900_002, ""), (900_003, LONG), (900_004, "one row that comes twice in this table"), (900_004, "one row that comes twice in this table"), (None, "a row that has no id but some words"), (900_005, "  ")]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"])
def test_stages_take_nulls_long_texts_repeated_rows_and_clashing_columns(spark, name):
    docs = odd(spark, EDGES)
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, AT)
    if name != "tokens":
        assert made.columns == docs.columns
    rows = [r for r in made.collect() if r.doc_id is None or r.doc_id > 900_000]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in EDGES)  # all are clean and unlike
    if name == "tokens":
        size = {r.doc_id: len(r.ids) for r in rows}
        assert size[900_001] == size[900_002] == 0
        assert size[900_003] > 4 * 120_000
    else:
        assert sorted((str(r.doc_id), r.text or "", r.score, r.ids) for r in rows) == sorted((str(i), t or "", "s", "i") for i, t in EDGES)


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"])
def test_stages_take_an_empty_table(spark, name):
    made = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([], ODD), AT)
    assert made.collect() == []


def test_near_copies_of_long_and_repeated_texts_leave_one(spark):
    rows = [(910_000, LONG), (910_001, LONG.replace("word77 ", "other ")), (910_002, "five words are in here now"), (910_002, "five words are in here now"), (910_003, "five words are in here now")]
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd(spark, rows), AT).where("doc_id >= 910000").collect()
    assert sorted(r.doc_id for r in kept) == [910_000, 910_002, 910_002]
