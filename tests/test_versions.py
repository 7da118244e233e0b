import json

import pytest
from pyspark.sql import functions as F

from feedloom.sources import papers as papers_
from feedloom.sources import versions


def folder(tmp_path, name, *papers):
    at = tmp_path / name
    at.mkdir()
    for i, p in enumerate(papers):
        (at / f"{i}.json").write_text(json.dumps({"created_at": "2024-01-01T10:00:00", "updated_at": "2024-01-02T10:00:00"} | p))
    return str(at)


def seen(spark, path, version=None):
    papers, mirror = versions.latest(spark, path, version)
    return {(r.ref, r.title) for r in papers.select("ref", "title").collect()}, {(r.id, r.title) for r in mirror.collect()}


def test_both_parts_are_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert [x.count() for x in versions.latest(spark, path)] == [0, 0]
    first = papers_.read_papers(spark, folder(tmp_path, "one", {"session_id": "a", "title": "A", "arxiv_id": "2401.1"}, {"session_id": "b", "title": "B", "arxiv_id": "2401.2"}))
    assert versions.saved(first, path) == 1
    want = {("a", "A"), ("b", "B")}
    assert seen(spark, path) == (want, want)

    second = papers_.read_papers(spark, folder(tmp_path, "two", {"session_id": "b", "title": "B2", "arxiv_id": "2401.2"}, {"session_id": "c", "title": "C"}))

    def fails(papers):
        return as_is(papers).withColumn("title", F.raise_error(F.lit("disk full")).cast("string"))

    as_is = versions.as_chat_papers
    monkeypatch.setattr(versions, "as_chat_papers", fails)
    with pytest.raises(Exception, match="disk full"):  # the papers are written, the mirror is not
        versions.saved(second, path)
    assert seen(spark, path) == (want, want)

    monkeypatch.setattr(versions, "as_chat_papers", as_is)
    assert versions.saved(second, path) == 2
    assert seen(spark, path) == ({("a", "A"), ("b", "B2"), ("c", "C")}, {("a", "A"), ("b", "B2")})  # no id, no mirror
    assert seen(spark, path, 1) == (want, want)


def test_a_save_that_was_overtaken_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = papers_.read_papers(spark, folder(tmp_path, "one", {"session_id": "a", "title": "A", "arxiv_id": "2401.1"}))
    other = papers_.read_papers(spark, folder(tmp_path, "two", {"session_id": "a", "title": "other", "arxiv_id": "2401.1"}))
    write, calls = versions.write_papers, []

    def meanwhile(papers, at):
        write(papers, at)
        calls.append(at)
        if len(calls) == 1:
            versions.saved(other, path)

    monkeypatch.setattr(versions, "write_papers", meanwhile)
    with pytest.raises(FileExistsError, match="version 1"):
        versions.saved(first, path)
    assert seen(spark, path) == ({("a", "other")}, {("a", "other")})
